"""Readers of delimited text whose delimiters, quoting and widths are not to be trusted."""

from concordia.sources.delimited import read_delimited
from concordia.sources.lines import cleaned_lines, errant_quotes, expand_row_text, file_delimiters, line_delimiter, line_delimiter_column

__all__ = ["read_delimited", "cleaned_lines", "errant_quotes", "expand_row_text", "file_delimiters", "line_delimiter", "line_delimiter_column"]
