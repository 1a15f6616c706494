"""Tokens and metrics of languages with braces (JavaScript, TypeScript, Go, Java, Rust, C), by regular expressions.

There is no grammar behind them: a slash that begins a regular expression literal is read as an operator, and a
function is what a keyword, an arrow or a name with parentheses before an opening brace says. Numbers are comparable
within this backend only.
"""

from __future__ import annotations

import re

_TOKEN = re.compile(r"""//[^\n]*|/\*.*?\*/|`(?:\\.|[^`\\])*`|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|\d[\w.]*|[^\W\d][\w$]*|\$[\w$]*|=>|->|&&|\|\||::|\?\?|\?\.|[^\s\w]""", re.S)
_LOOPS = frozenset("if for while switch match select catch loop do try else".split())
_KEYWORDS = _LOOPS | frozenset(
    "break case class const continue default defer delete enum export extends false final finally fn func function go goto impl implements import in instanceof interface let loop mod mut new null package private protected pub public return self static struct super this throw trait true type typeof undefined union unsafe use var void where yield async await chan map range nil int long float double bool boolean char string byte".split()
)
_BRANCHES, _FUNCTIONS = frozenset("if for while case catch && || ? ?? loop".split()), frozenset(("function", "func", "fn", "=>"))


def raw_tokens(body: str) -> list[tuple[str, int, int]]:
    """(token, first line, last line), without comments."""
    out, line, at = [], 1, 0
    for m in _TOKEN.finditer(body):
        line += body.count("\n", at, m.start())
        at, text = m.start(), m[0]
        if not text.startswith(("//", "/*")):
            out.append((text, line, line + text.count("\n")))
    return out


def tokens(body: str) -> list[tuple[str, int, int]]:
    """raw_tokens() with names and literals made alike."""
    kind = lambda t: "LIT" if t[0] in "\"'`" or t[0].isdigit() else "ID" if (t[0].isalpha() or t[0] in "_$") and t not in _KEYWORDS else t
    return [(kind(t), a, b) for t, a, b in raw_tokens(body)]


def metrics(body: str) -> tuple[int, int, int, int, int, int]:
    """loc, branches of the file + 1, the most of one function + 1 and its line, deepest nesting of control flow, functions."""
    total, functions, deepest, most, at_line = 0, 0, 0, 0, 0
    opened, blocks, before, waiting = [], [], "", None  # places of (, what each { opens, last token, function or loop announced
    named = None  # line of a name with closed parentheses
    inside: list[list[int]] = []  # [line, branches] of the functions around
    for text, line, _ in raw_tokens(body):
        if text in _BRANCHES:
            total += 1
            if inside:
                inside[-1][1] += 1
        if text in _FUNCTIONS:
            waiting = ("function", line)
        elif text in _LOOPS:
            waiting = ("loop", line)
        elif text == "(":
            opened.append((before, line))
        elif text == ")" and opened:
            name, start = opened.pop()
            named = start if (name[:1].isalpha() or name[:1] in ("_", "$")) and name not in _KEYWORDS else None
        elif text == ";":
            waiting = named = None
        elif text == "{":
            kind = waiting or (("function", named) if before == ")" and named else ("other", line))
            blocks.append(kind[0])
            if kind[0] == "function":
                functions += 1
                inside.append([kind[1], 0])
            deepest, waiting, named = max(deepest, blocks.count("loop")), None, None
        elif text == "}" and blocks:
            if blocks.pop() == "function":
                start, n = inside.pop()
                if n + 1 > most:
                    most, at_line = n + 1, start
        elif waiting and waiting[0] == "function" and before == "=>":  # an arrow to an expression
            functions, waiting = functions + 1, None
        before = text
    return sum(1 for x in body.splitlines() if x.strip()), total + 1, most, at_line, deepest, functions
