"""Segmentation of a single text where rows and expressions can't say it: fences, sections, sentences, long segments.

Functions give ``(text, start, end, is_code, level)``, with offsets in bytes, in order of start.
"""

from __future__ import annotations

import re
from functools import lru_cache

from textmill.functions.text import MAX_BYTES, MIN_BYTES

Piece = tuple[str, int, int, bool, int]
_FENCE = "```"
#: Unicode White_Space; ``str.isspace`` also counts U+001C to U+001F.
SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
_HEADING = re.compile(r"(#{1,6}) ")


def size(text: str) -> int:
    return len(text.encode("utf-8", "surrogatepass"))


def level_of(line: str) -> int:
    m = _HEADING.match(line.strip(SPACE))
    return len(m[1]) if m else 0


def _fenced(line: str) -> bool:
    return line.strip(SPACE).startswith(_FENCE)


def lines_of(text: str) -> list[tuple[str, int]]:
    """Lines without their ends, and how many bytes each takes with them."""
    parts = text.split("\n")
    if parts and not parts[-1]:
        parts.pop()
    return [(p.removesuffix("\r"), size(p) + 1) for p in parts]


def is_fenced_block(text: str) -> bool:
    t = text.strip(SPACE)
    return t.startswith(_FENCE) and t.endswith(_FENCE) and size(t) > 6


def cut_long(text: str, limit: int = MAX_BYTES) -> list[tuple[str, int, int]]:
    """``(text, start, end)`` of parts of at most ``limit`` bytes, cut after the last sentence, else the last space.

    The limit falls back to the start of a character. Offsets leave out white space dropped between parts, so they run
    ahead of none of it.
    """
    out, raw, at = [], text.encode("utf-8"), 0
    while len(raw) > limit:
        edge = limit
        while edge and raw[edge] & 0xC0 == 0x80:
            edge -= 1
        window = raw[:edge]
        cut = next((p + n for mark, n in ((b". ", 2), (b".\n", 2), (b" ", 1)) if (p := window.rfind(mark)) >= 0), edge)
        out.append((raw[:cut].decode(), at, at + cut))
        raw = raw[cut:].decode().lstrip(SPACE).encode()
        at += cut
    if len(raw) >= MIN_BYTES:
        out.append((raw.decode(), at, at + len(raw)))
    return out


def paragraphs(text: str) -> list[Piece]:
    out, at = [], 0
    for part in text.split("\n\n"):
        t = part.strip(SPACE)
        start = at + size(part) - size(part.lstrip(SPACE))
        at += size(part) + 2
        n = size(t)
        if n > MAX_BYTES:
            for k, (x, a, b) in enumerate(cut_long(t)):
                out.append((x, start + a, start + b, False, level_of(x.split("\n", 1)[0]) if k == 0 else 0))
        elif n >= MIN_BYTES:
            out.append((t, start, start + n, False, level_of(t.split("\n", 1)[0])))
    return out


def lines(text: str) -> list[Piece]:
    out, at = [], 0
    for line, width in lines_of(text):
        t = line.strip(SPACE)
        if size(t) >= MIN_BYTES:
            out.append((t, at, at + size(line), False, level_of(line)))
        at += width
    return out


def semantic(text: str, compat: str = "fixed") -> list[Piece]:
    """Code blocks, sections under headings, and paragraphs, found line by line.

    With ``compat="reference"`` the line after a blank line at which a paragraph would begin is lost.
    """
    rows = lines_of(text)
    kinds = ["fence" if _fenced(x) else "head" if level_of(x) else "blank" if not x.strip(SPACE) else "text" for x, _ in rows]
    starts = [0]
    for _, width in rows:
        starts.append(starts[-1] + width)
    out: list[Piece] = []
    k, n = 0, len(rows)

    def until(at: int, stops: tuple[str, ...]) -> int:
        return next((j for j in range(at, n) if kinds[j] in stops), n)

    def body(a: int, b: int) -> str:
        return "".join(x + "\n" for x, _ in rows[a:b])

    while k < n:
        kind = kinds[k]
        if kind == "fence":
            end = min(until(k + 1, ("fence",)) + 1, n)
            block = body(k, end)
            if size(block) >= MIN_BYTES:
                out.append((block.rstrip(SPACE), starts[k], starts[end], True, 0))
        elif kind == "blank":
            end = k + 1 if compat == "fixed" else k + 2
        else:
            end = until(k + 1, ("head", "fence") if kind == "head" else ("head", "fence", "blank"))
            t = body(k, end).strip(SPACE)
            if kind == "text" and end < n and kinds[end] == "blank":
                end += 1
            if size(t) >= MIN_BYTES:
                out.append((t, starts[k], starts[min(end, n)], False, level_of(rows[k][0])))
        k = end
    return out


def code_blocks(text: str) -> list[tuple[int, int]]:
    """Character spans of fenced blocks: a fence anywhere, and a later line that begins with one."""
    out, at = [], 0
    while (a := text.find(_FENCE, at)) >= 0:
        feed = text.find("\n", a)
        inside = feed + 1 if feed >= 0 else a + len(_FENCE)
        close = text.find("\n" + _FENCE, inside)
        if close < 0:
            at = inside
            continue
        end = close + 1 + len(_FENCE)
        at = end + text.startswith("\n", end)
        out.append((a, at))
    return out


def with_code(text: str, mode: str, compat: str = "fixed") -> list[Piece]:
    """Fenced blocks whole, the text between them by ``mode``."""
    if mode == "semantic":
        return semantic(text, compat)
    out: list[Piece] = []
    at = base = 0
    for a, b in [*code_blocks(text), (len(text), len(text))]:
        between, block = text[at:a], text[a:b]
        out += [(t, base + s, base + e, False, h) for t, s, e, _, h in MODES[mode](between)]
        base += size(between)
        if size(block) >= MIN_BYTES:
            out.append((block, base, base + size(block), True, 0))
        base += size(block)
        at = b
    return sorted(out, key=lambda p: p[1])


@lru_cache(maxsize=1)
def _sentence_classes():
    import regex

    names = ("CR", "LF", "Sep", "Extend", "Format", "Sp", "Lower", "Upper", "OLetter", "Numeric", "ATerm", "SContinue", "STerm", "Close")
    return {n: regex.compile(rf"\p{{Sentence_Break={n}}}") for n in names}


@lru_cache(maxsize=4096)
def _sentence_class(c: str) -> str:
    return next((n for n, r in _sentence_classes().items() if r.match(c)), "Other")


def sentence_ends(text: str) -> list[int]:
    """Ends of sentences by the default rules of Unicode annex 29, in characters."""
    kinds = [_sentence_class(c) for c in text]
    n, ends, k = len(text), [], 0
    # rule 5: format and extending characters are seen through
    skip = lambda j: next((x for x in range(j, n) if kinds[x] not in ("Extend", "Format")), n)
    before = ""  # class of the last character seen, for rule 7
    while k < n:
        kind = kinds[k]
        if kind in ("CR", "LF", "Sep"):  # rules 3 and 4
            k += 2 if kind == "CR" and k + 1 < n and kinds[k + 1] == "LF" else 1
            ends.append(k)
            before = ""
            continue
        if kind not in ("ATerm", "STerm"):
            if kind not in ("Extend", "Format"):
                before = kind
            k += 1
            continue
        j = skip(k + 1)
        nxt = kinds[j] if j < n else ""
        if kind == "ATerm" and (nxt == "Numeric" or before in ("Upper", "Lower") and nxt == "Upper"):  # rules 6 and 7
            before, k = kind, j
            continue
        while j < n and kinds[j] == "Close":
            j = skip(j + 1)
        while j < n and kinds[j] == "Sp":
            j = skip(j + 1)
        nxt = kinds[j] if j < n else ""
        if nxt in ("SContinue", "ATerm", "STerm"):  # rule 8a
            before, k = kind, j
            continue
        if kind == "ATerm":  # rule 8: a small letter before anything that would begin a sentence
            look = j
            while look < n and kinds[look] not in ("OLetter", "Upper", "Lower", "CR", "LF", "Sep", "STerm", "ATerm"):
                look += 1
            if look < n and kinds[look] == "Lower":
                before, k = kind, max(j, k + 1)
                continue
        if nxt in ("CR", "LF", "Sep"):  # rules 9 to 11 take the line end along
            j += 2 if nxt == "CR" and j + 1 < n and kinds[j + 1] == "LF" else 1
        ends.append(j)
        before, k = "", j
    if n and (not ends or ends[-1] != n):
        ends.append(n)
    return ends


def sentences(text: str) -> list[Piece]:
    out, at, base = [], 0, 0
    for end in sentence_ends(text):
        raw = text[at:end]
        t = raw.strip(SPACE)
        if size(t) >= MIN_BYTES:
            start = base + size(raw) - size(raw.lstrip(SPACE))
            out.append((t, start, start + size(t), False, 0))
        base += size(raw)
        at = end
    return out


MODES = {"paragraph": paragraphs, "line": lines, "sentence": sentences, "semantic": semantic}
