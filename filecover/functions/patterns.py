"""Regular expressions as Python reads them, written for the engine's own functions.

A pattern is parsed by Python and its parts are written out as a Java expression, so that it means on executors
what it means in Python: Unicode classes and word boundaries, line ends, named groups and references, flags. What
has no counterpart is refused before any job runs.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import groupby
from re import _constants as op
from re import _parser

# What Python takes for blank, as a Java class.
_SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_UNICODE = {op.CATEGORY_DIGIT: r"\p{Nd}", op.CATEGORY_SPACE: _SPACE, op.CATEGORY_WORD: r"\p{L}\p{N}_"}
_ASCII = {op.CATEGORY_DIGIT: "0-9", op.CATEGORY_SPACE: r"\t-\r\x{20}", op.CATEGORY_WORD: "a-zA-Z0-9_"}
_NEGATED = {
    op.CATEGORY_NOT_DIGIT: op.CATEGORY_DIGIT,
    op.CATEGORY_NOT_SPACE: op.CATEGORY_SPACE,
    op.CATEGORY_NOT_WORD: op.CATEGORY_WORD,
}
_ANY = r"[\x{0}-\x{10ffff}]"
_REPEATS = {op.MAX_REPEAT: "", op.MIN_REPEAT: "?", op.POSSESSIVE_REPEAT: "+"}
_LARGEST = 2**31 - 1


@lru_cache(maxsize=1)
def _characters() -> str:
    return "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))


@lru_cache(maxsize=1024)
def _either_case(spans: tuple, ascii_only: bool) -> str:
    """The inside of a Java class: all characters that Python finds for these spans when case is ignored."""
    inside = "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in spans)
    found = re.findall(f"[{inside}]", _characters(), re.IGNORECASE | (re.ASCII if ascii_only else 0))
    runs = groupby(enumerate(map(ord, found)), lambda x: x[1] - x[0])
    ends = [(own[0][1], own[-1][1]) for own in (list(run) for _, run in runs)]
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ends)


class _Writer:
    def __init__(self, pattern: str):
        self.pattern = pattern

    def refuse(self, what: str):
        raise ValueError(f"{what} has no counterpart on executors: {self.pattern!r}")

    def sequence(self, parts, flags: int) -> str:
        return "".join(self.part(kind, value, flags) for kind, value in parts)

    def part(self, kind, value, flags: int) -> str:
        method = getattr(self, f"_{str(kind).lower()}", None)
        if kind in _REPEATS:
            return self._repeat(kind, value, flags)
        return method(value, flags) if method else self.refuse(str(kind))

    # Characters. Each is an atom, so that a repeat may follow.

    @staticmethod
    def _span(first: int, last: int, flags: int) -> str:
        if flags & re.IGNORECASE:
            return _either_case(((first, last),), bool(flags & re.ASCII))
        return rf"\x{{{first:x}}}-\x{{{last:x}}}"

    def _literal(self, code: int, flags: int) -> str:
        return f"[{self._span(code, code, flags)}]" if flags & re.IGNORECASE else rf"\x{{{code:x}}}"

    def _not_literal(self, code: int, flags: int) -> str:
        return self._other_than(self._span(code, code, flags))

    def _other_than(self, inside: str) -> str:
        return f"(?:(?![{inside}]){_ANY})"

    def _any(self, _, flags: int) -> str:
        return _ANY if flags & re.DOTALL else r"[^\n]"

    def _in(self, items, flags: int) -> str:
        negated = items[0][0] is op.NEGATE
        inside = "".join(self._item(kind, value, flags) for kind, value in items[negated:])
        return self._other_than(inside) if negated else f"[{inside}]"

    def _item(self, kind, value, flags: int) -> str:
        if kind in (op.LITERAL, op.RANGE):
            return self._span(*(value if kind is op.RANGE else (value, value)), flags)
        classes = _ASCII if flags & re.ASCII else _UNICODE
        return f"[^{classes[_NEGATED[value]]}]" if value in _NEGATED else classes[value]

    # Places.

    def _at(self, where, flags: int) -> str:
        word = f"[{(_ASCII if flags & re.ASCII else _UNICODE)[op.CATEGORY_WORD]}]"
        edge = rf"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))"
        lines = flags & re.MULTILINE
        return {
            op.AT_BEGINNING: r"(?:\A|(?<=\n))" if lines else r"\A",
            op.AT_BEGINNING_STRING: r"\A",
            op.AT_END: r"(?=\n|\z)" if lines else r"(?=\n?\z)",
            op.AT_END_STRING: r"\z",
            op.AT_BOUNDARY: edge,
            op.AT_NON_BOUNDARY: rf"(?!{edge})(?!\A\z)",  # an empty text has no place between letters
        }[where]

    # Groups.

    def _subpattern(self, value, flags: int) -> str:
        group, added, removed, parts = value
        inside = self.sequence(parts, (flags | added) & ~removed)
        return f"({inside})" if group is not None else f"(?:{inside})"

    def _branch(self, value, flags: int) -> str:
        return f"(?:{'|'.join(self.sequence(parts, flags) for parts in value[1])})"

    def _atomic_group(self, parts, flags: int) -> str:
        return f"(?>{self.sequence(parts, flags)})"

    def _assert(self, value, flags: int) -> str:
        ahead, parts = value
        return f"(?{'=' if ahead > 0 else '<='}{self.sequence(parts, flags)})"

    def _assert_not(self, value, flags: int) -> str:
        ahead, parts = value
        return f"(?{'!' if ahead > 0 else '<!'}{self.sequence(parts, flags)})"

    def _failure(self, *_) -> str:
        return r"(?!)"

    def _groupref(self, group: int, flags: int) -> str:
        if flags & re.IGNORECASE:
            return rf"(?i{'' if flags & re.ASCII else 'u'}:\{group})"
        return rf"(?:\{group})"

    def _groupref_exists(self, *_) -> str:
        return self.refuse("a condition on a group")

    def _repeat(self, kind, value, flags: int) -> str:
        least, most, parts = value
        if least > _LARGEST or (most is not op.MAXREPEAT and most > _LARGEST):
            return self.refuse("so large a repeat")
        upper = "" if most is op.MAXREPEAT else most
        return f"(?:{self.sequence(parts, flags)}){{{least},{upper}}}{_REPEATS[kind]}"


def java_pattern(pattern: str) -> str:
    """The Java expression that finds what ``re.search(pattern, text)`` finds. ValueError for what isn't a pattern, or has no counterpart."""
    try:
        re.compile(pattern)
        parsed = _parser.parse(pattern)
    except (re.error, OverflowError, RecursionError) as e:
        raise ValueError(f"not a regular expression: {pattern!r} ({e})") from e
    return _Writer(pattern).sequence(parsed, parsed.state.flags)
