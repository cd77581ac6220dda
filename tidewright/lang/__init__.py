"""The dialect: lexer, syntax tree and parser."""
