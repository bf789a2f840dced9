"""Tokens of both dialects."""

from __future__ import annotations

import re
from dataclasses import dataclass


class SqlError(ValueError):
    """A text that the dialect doesn't accept; names line and column."""


@dataclass(frozen=True)
class Token:
    kind: str  # word, quoted (identifier), string, number, op, template, end
    text: str
    start: int
    stop: int

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == "word" else self.text


_COMMON = r"""
  (?P<space>\s+|--[^\n]*|/\*.*?\*/)
 |(?P<template>\$\{\w+\})
 |(?P<number>0[xX][0-9a-fA-F]+|(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?(?:BD|[LSYD])?(?![\w.]))
 |(?P<word>[A-Za-z_0-9][\w]*(?:\$\{\w+\}\w*)*)
 |(?P<op><=>|->|\|\||::|<>|!=|<=|>=|==|[-+*/%(),.;<>=\[\]{}?:&|^~!@])
"""
_HIVE = re.compile(r"""(?P<string>'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*")|(?P<quoted>`(?:[^`]|``)*`)|""" + _COMMON, re.X | re.S)
_CLICKHOUSE = re.compile(r"""(?P<string>'(?:[^'\\]|\\.|'')*')|(?P<quoted>`(?:[^`\\]|\\.)*`|"(?:[^"\\]|\\.)*")|""" + _COMMON, re.X | re.S)


def place(text: str, at: int) -> str:
    line = text.count("\n", 0, at) + 1
    return f"line {line}:{at - (text.rfind(chr(10), 0, at) + 1)}"


def tokenize(text: str, dialect: str) -> list[Token]:
    pattern, at, out = _CLICKHOUSE if dialect == "clickhouse" else _HIVE, 0, []
    while at < len(text):
        m = pattern.match(text, at)
        if not m:
            raise SqlError(f"{place(text, at)}: unexpected {text[at : at + 10]!r}")
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup, m.group(), at, m.end()))
        at = m.end()
    out.append(Token("end", "", at, at))
    return out
