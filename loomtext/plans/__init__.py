"""Query language: lexer, parser, syntax tree and its compilation to Columns."""
