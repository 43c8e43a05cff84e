"""Texts as runs of pieces that a pre-tokenising BPE vocabulary treats independently.

A single space between two visible characters is a boundary for the pre-tokenisers of the public
byte-level and word-level vocabularies: the space belongs to what follows (or is dropped), and nothing
before it is affected.  So a text can be cut there, each distinct piece encoded once, and the results
put together.  Where the neighbours of a space are anything but letters or printable ASCII (other white
space, combining marks, unassigned code points), the text is not cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

#: Characters per window; a long text is handled window by window.
WINDOW = 1 << 18
#: Characters of texts whose new pieces are learned at once.
TOGETHER = 1 << 14
#: Remembered pieces per worker process, about 200 bytes each; those not met for the longest time are forgotten.
REMEMBERED = 1_500_000
#: Bytes handed to the encoder at once, at least one piece.
BATCH_BYTES = 1 << 20


def _visible(c: str) -> bool:
    return "!" <= c <= "~" or c.isalpha()


def _clean(part: str) -> bool:
    return bool(part) and _visible(part[0]) and _visible(part[-1])


def windows(text: str, size: int = WINDOW) -> Iterator[str]:
    """Consecutive parts of ``text``, cut before spaces that are boundaries; all but the first begin with that space.

    A part is longer than ``size`` only where the text has no boundary for so long.
    """
    start = 0
    while len(text) - start > size:
        at = start + size
        while 0 <= (at := text.find(" ", at)) < len(text) - 1 and not (_visible(text[at - 1]) and _visible(text[at + 1])):
            at += 1
        if not 0 < at < len(text) - 1:
            break
        yield text[start:at]
        start = at
    yield text[start:]


#: Signs that, after ASCII letters, are a word of their own for every pre-tokeniser.
SIGNS = frozenset(".,;:!?")
UNCLEAN = "unclean"


class Pieces:
    """Values of texts, put together from the values of their distinct pieces.

    ``encode`` gives one value for each of a list of strings; values of neighbours add up with ``+``.
    ``values`` gives, for each text, the list of its pieces' values in order.
    """

    def __init__(self, encode: Callable[[list[str]], list], remembered: int = REMEMBERED):
        self.encode, self.remembered = encode, remembered
        self.known: dict[str, object] = {}  # by the piece without its leading space; UNCLEAN: not a piece of its own
        self.older: dict[str, object] = {}  # known before the newer half was begun
        self.lines: dict[str, object] = {}  # words after a line feed, with it
        self.signs = dict(zip(sorted(SIGNS), encode(sorted(SIGNS))))

    def _encoded(self, pieces: list[str]) -> list:
        out, batch, size = [], [], 0
        for piece in pieces:
            batch.append(piece)
            size += 4 * len(piece)
            if size >= BATCH_BYTES:
                out += self.encode(batch)
                batch, size = [], 0
        return out + (self.encode(batch) if batch else [])

    def _learn(self, parts: set[str]) -> None:
        """Make the values of ``parts``, none of them known, known.

        A part is put together from smaller ones where that is safe: at single line feeds between visible
        characters, and before a sign that follows ASCII letters.
        """
        known, older, lines = self.known, self.older, self.lines
        if 8 * len(lines) > self.remembered:
            lines.clear()
        joined, signed, new = [], [], {" ": set(), "\n": set()}

        def need(table: dict, separator: str, word: str) -> None:
            if word in table:
                return
            if word[-1] in SIGNS and (stem := word[:-1]).isalpha() and stem.isascii():
                signed.append((table, word))
                need(table, separator, stem)
            elif separator == " " and word in older:
                table[word] = older[word]
            else:
                new[separator].add(word)

        plain = new[" "]
        for p in parts:
            if p in older:
                known[p] = older[p]
            elif p.isalpha():
                plain.add(p)
            elif not _clean(p):
                known[p] = UNCLEAN
            elif "\n" in p and all(map(_clean, rows := p.split("\n"))):
                joined.append((p, rows))
                need(known, " ", rows[0])
                for row in rows[1:]:
                    need(lines, "\n", row)
            else:
                need(known, " ", p)
        for separator, table in ((" ", known), ("\n", lines)):
            todo = list(new[separator])
            table.update(zip(todo, self._encoded([separator + w for w in todo])))
        for table, word in signed:
            table[word] = table[word[:-1]] + self.signs[word[-1]]
        for p, rows in joined:
            value = known[rows[0]]
            for row in rows[1:]:
                value = value + lines[row]
            known[p] = value

    def _window(self, window: str) -> list:
        head, *rest = window.split(" ")  # only the first window of a text can have a head
        if 2 * len(self.known) > self.remembered:
            self.known, self.older = {}, self.known
        values = list(map(self.known.get, rest))
        if None in values:
            self._learn({p for p, v in zip(rest, values) if v is None})
            values = list(map(self.known.get, rest))
        if UNCLEAN in values or head and rest and not _visible(head[-1]):
            return self._encoded(self._joined(head, rest))
        return (self._encoded([head]) if head else []) + values

    def _group(self, windows_: list[str]) -> list[list]:
        """The values of each window; what is new in any of them is learned at once."""
        if 2 * len(self.known) > self.remembered:
            self.known, self.older = {}, self.known
        known = self.known
        heads, rests, values, gaps, new = [], [], [], [], set()
        for window in windows_:
            head, *rest = window.split(" ")  # only the first window of a text can have a head
            found = list(map(known.get, rest))
            if None in found:
                missing = [k for k, v in enumerate(found) if v is None]
                gaps.append((found, rest, missing))
                new.update([rest[k] for k in missing])
            heads.append(head)
            rests.append(rest)
            values.append(found)
        if new:
            self._learn(new)
            for found, rest, missing in gaps:
                for k in missing:
                    found[k] = known[rest[k]]
        # Heads, and windows that cannot be cut everywhere, are encoded as they are, together.
        whole = [UNCLEAN in found or bool(head and rest) and not _visible(head[-1]) for head, rest, found in zip(heads, rests, values)]
        uncut = [self._joined(head, rest) if w else [head] if head else [] for head, rest, w in zip(heads, rests, whole)]
        encoded = iter(self._encoded([p for pieces in uncut for p in pieces]))
        return [[next(encoded) for _ in pieces] + ([] if w else found) for pieces, w, found in zip(uncut, whole, values)]

    @staticmethod
    def _joined(head: str, rest: list[str]) -> list[str]:
        """The window cut only at its start and where both neighbours of a space are visible."""
        out = [head]
        for part in rest:
            if not out[-1] or part and _visible(out[-1][-1]) and _visible(part[0]):
                out.append(f" {part}")
            else:
                out[-1] += f" {part}"
        return [p for p in out if p]

    def values(self, text: str, window: int = WINDOW) -> Iterator[list]:
        """One list of values for each window of the text; nothing for an empty text."""
        if text:
            yield from map(self._window, windows(text, window))

    def each(self, texts: Iterable[str], together: int = TOGETHER, window: int = WINDOW) -> Iterator[list]:
        """The values of every text; short texts are taken together, up to ``together`` characters."""
        held, size = [], 0
        for text in texts:
            if size + len(text) > together and held:
                yield from self._group(held)
                held, size = [], 0
            if len(text) > together:
                yield [v for part in self.values(text, window) for v in part]
            else:
                held.append(text)
                size += len(text)
        if held:
            yield from self._group(held)
