"""Operators for preparing text corpora: filters, joins, packing, token counts, chat formatting.

Nothing outside this subpackage imports it.
"""
