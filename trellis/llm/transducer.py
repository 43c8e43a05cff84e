"""BPE encoding and decoding as streaming transducers.

Encoding.  Merges are applied in order of rank, leftmost first.  What follows a position can change tokens
before it only through a chain of merges of rising rank, each of which takes part in a token that the one
before it made or used up.  ``sufficient_lookahead`` follows all such chains of a merge list and adds up how
far to the left they can reach.  So of the tokens of a window, those that end at least that many symbols
before the window's end are final, whatever follows; they are emitted, and the rest is merged anew together
with the next symbols (tokens to the right of a token boundary do not depend on what is before it).  Memory is
a window and the lookahead, however long a word is.

Decoding.  Tokens give bytes; complete UTF-8 sequences are emitted as text and an unfinished one is the
state.  A vocabulary without a decoder gives its tokens' spellings joined by spaces.
"""

from __future__ import annotations

import codecs
import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from trellis.llm.memory import held
from trellis.llm.pieces import Pieces
from trellis.llm.schema import extended
from trellis.llm.shipping import ship

#: Symbols of a word that are merged at once, besides the lookahead.
BLOCK = 512
#: Pieces that a worker remembers.
REMEMBERED = 600_000
#: A space and letters that every normaliser leaves alone or lower-cases.
PLAIN = re.compile(" [A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Ids of a row that are decoded at once.
DECODE_IDS = 1 << 16


def sufficient_lookahead(merges: list[tuple[str, str]], size=len) -> int:
    """Symbols after which nothing can change the tokens before; ``size`` counts a token's symbols.

    ``reach`` of a merge is how far left of the first changed symbol an effect can have come once it takes part.
    A later merge joins the chain by its right part (used up by a merge to the right, or made by one), which
    takes the effect left by its left part's size, or by its left part (made, or used up from the left), which
    does not.
    """
    begun: dict[str, int] = {}  # reach by the left part of earlier merges
    made: dict[str, int] = {}  # by what they make
    ended: dict[str, int] = {}  # by their right part
    most = 1
    for left, right in merges:
        a, b = size(left), size(right)
        reach = max(
            a + b,
            a + max(begun.get(right, 0), made.get(right, 0)),
            made.get(left, 0),
            ended.get(left, 0),
        )
        for table, token in ((begun, left), (made, left + right), (ended, right)):
            table[token] = max(table.get(token, 0), reach)
        most = max(most, reach)
    return most


class Encoder:
    """Merges symbols to tokens, word by word."""

    def __init__(self, merges: list[tuple[str, str]], lookahead: int | None = None, block: int = BLOCK):
        self.ranks = {pair: k for k, pair in enumerate(merges)}
        self.lookahead = sufficient_lookahead(merges) if lookahead is None else lookahead
        self.block = block

    def merge(self, symbols: list[str]) -> list[str]:
        """All tokens of a finite word."""
        ranks, none = self.ranks, len(self.ranks)
        tokens = list(symbols)
        order = [ranks.get(p, none) for p in zip(tokens, tokens[1:])]
        while order and (best := min(order)) < none:
            k = order.index(best)
            tokens[k : k + 2] = [tokens[k] + tokens[k + 1]]
            del order[k]
            if k:
                order[k - 1] = ranks.get((tokens[k - 1], tokens[k]), none)
            if k < len(order):
                order[k] = ranks.get((tokens[k], tokens[k + 1]), none)
        return tokens

    def stream(self, symbols: Iterable[str], width=len) -> Iterator[str]:
        """Tokens of a word of any length, as soon as they are stable; ``width`` counts a token's symbols."""
        source, held = iter(symbols), []
        while True:
            held += islice(source, self.block + self.lookahead - len(held))
            tokens = self.merge(held)
            if len(held) < self.block + self.lookahead:
                yield from tokens
                return
            final, end = len(held) - self.lookahead, 0
            for token in tokens:
                if end + width(token) > final:
                    break
                end += width(token)
                yield token
            if not end:
                raise ValueError("a token is longer than the block")
            held = held[end:]


class Decoder:
    """Ids to text, piece by piece: ``feed`` as often as there are ids, then ``finish``."""

    def __init__(self, tokens: dict[int, str], byte_of: dict[str, int] | None):
        """``byte_of`` maps the characters of byte-level spellings; None: spellings are joined by spaces."""
        self.as_bytes = byte_of is not None
        self.table = np.full(max(tokens, default=-1) + 2, None, object)  # the last entry stands for unknown ids
        for k, t in tokens.items():
            self.table[k] = _to_bytes(t, byte_of) if byte_of else t
        self.begin()

    def begin(self) -> None:
        self.pending = codecs.getincrementaldecoder("utf-8")("replace")
        self.first = True

    def feed(self, ids: np.ndarray) -> str:
        known = self.table[np.where((ids >= 0) & (ids < len(self.table)), ids, -1)].tolist()
        if None in known:
            known = [t for t in known if t is not None]
        if self.as_bytes:
            return self.pending.decode(b"".join(known))
        text = ("" if self.first or not known else " ") + " ".join(known)
        self.first = self.first and not known
        return text

    def finish(self) -> str:
        """What is left, and back to the start."""
        text = self.pending.decode(b"", True) if self.as_bytes else ""
        self.begin()
        return text


def byte_letters() -> dict[int, str]:
    """The characters that byte-level vocabularies write bytes as: visible ones stand for themselves, the others follow from 256 on."""
    visible = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = (b for b in range(256) if b not in visible)
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(others)}


def _to_bytes(token: str, byte_of: dict[str, int]) -> bytes:
    mapped = [byte_of.get(c) for c in token]
    return token.encode() if None in mapped else bytes(mapped)


class Vocabulary:
    """A BPE vocabulary file: its normaliser and word splitter come from the library, merging and decoding from here."""

    def __init__(self, path: str, block: int = BLOCK):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        self.encoder = Encoder(merges, sufficient_lookahead(merges, self._width), block)
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None
        spellings = {i: t for t, i in (self.ids | self.special).items()}
        self.decoder = Decoder(spellings, {c: b for b, c in byte_letters().items()} if spec["decoder"] else None)
        # what the library makes of a space and plain letters: the lower-cased word, or the word with the space's sign
        self.plain_words = {("ab",): True, ("ĠaB",): False}.get(tuple(w for w, _ in self._split(" aB")))
        self.letters = byte_letters()
        self.words: dict[str, bytes] = {}
        self.pieces = Pieces(lambda texts: [self.encode_piece(t) for t in texts], REMEMBERED)

    def _width(self, token: str) -> int:
        return len(token.removesuffix(self.suffix)) if self.suffix else len(token)

    def _symbols(self, word: str) -> list[str]:
        return [*word[:-1], word[-1] + self.suffix]

    def _ids(self, tokens: Iterable[str]) -> bytes:
        return array("i", [self.ids[t] for t in tokens if t in self.ids]).tobytes()

    def _word(self, word: str) -> bytes:
        if len(word) > self.encoder.block:
            return self._ids(self.encoder.stream(self._symbols(word), self._width))
        found = self.words.get(word)
        if found is None:
            if len(self.words) >= REMEMBERED // 4:
                self.words.clear()
            found = self.words[word] = self._ids(self.encoder.merge(self._symbols(word)))
        return found

    def _split(self, text: str) -> list:
        return self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text) if self.normalizer else text)

    def encode_piece(self, piece: str) -> bytes:
        """Ids (32-bit) of a piece of text that no word crosses."""
        if self.plain_words is not None and PLAIN.fullmatch(piece):
            word = piece[1:].lower() if self.plain_words else piece[1:]
            word = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
            return self._word(word if self.plain_words else "Ġ" + word)
        out = []
        for k, part in enumerate(self.special_pattern.split(piece) if self.special_pattern else [piece]):
            if k % 2:
                out.append(array("i", [self.special[part]]).tobytes())
            elif part:
                out += [self._word(word) for word, _ in self._split(part) if word]
        return b"".join(out)

    def encode(self, text: str) -> Iterator[np.ndarray]:
        """Ids of a text, window by window."""
        for values in self.pieces.values(text):
            yield np.frombuffer(b"".join(values), np.int32)

    def decode(self, ids: np.ndarray) -> Iterator[str]:
        """Text of ids, piece by piece."""
        for at in range(0, len(ids), DECODE_IDS):
            yield self.decoder.feed(ids[at : at + DECODE_IDS])
        yield self.decoder.finish()


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary at ``path``, with the pieces it remembers."""
    return held(("transducer", path), lambda: Vocabulary(path))


def _mapped(rows: DataFrame, column: str, kind: str, run) -> DataFrame:
    """``rows`` with its column ``column`` turned into one of type ``kind`` by ``run``, value by value; nothing moves."""
    ship(rows.sparkSession)
    at = rows.columns.index(column)
    fields = rows.schema.fields
    schema = StructType([*fields[:at], *extended([], f"`{column}` {kind}").fields, *fields[at + 1 :]])
    names = rows.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns
            columns[at] = run(columns[at])
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(each, schema)


def encode(docs: DataFrame, path: str, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """``keep`` columns and the token ids (array<int>) of every whole text.

    Null and empty texts have no ids.  Special strings in texts are their special tokens.  Rows may repeat; other
    columns are ignored; an empty table gives an empty result.
    """

    def run(texts: pa.Array) -> pa.Array:
        vocab, windows, ends = vocabulary(path), [np.zeros(0, np.int32)], [0]
        for value in texts:
            end = ends[-1]
            for window in vocab.encode(value.as_py() or ""):
                windows.append(window)
                end += len(window)
            ends.append(end)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(windows)))

    return _mapped(docs.select(*keep, docs[text].alias(ids)), ids, "array<int>", run)


def decode(encoded: DataFrame, path: str, *, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns and the text of every array of ids, special tokens included; null arrays have an empty text."""

    def run(arrays: pa.Array) -> pa.Array:
        vocab, none = vocabulary(path), np.zeros(0, np.int32)
        numbers = (value.values.to_numpy(zero_copy_only=False) if value.is_valid else none for value in arrays)
        return pa.array(("".join(vocab.decode(ids)) for ids in numbers), pa.string())

    return _mapped(encoded.select(*keep, encoded[ids].alias(text)), text, "string", run)


#: Rows that a round trip holds as ids and as text at once.
ROUND_TRIP_ROWS = 256


def round_trip(docs: DataFrame, path: str, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``keep`` columns, the token ids of every whole text and the text that these decode to.

    The same as :func:`encode` and :func:`decode` one after the other, with one worker and one vocabulary a task
    instead of two, and few rows at a time.
    """
    ship(docs.sparkSession)
    rows = docs.select(*keep, docs[text].alias(ids))
    schema = StructType([*rows.schema.fields[:-1], *extended([], f"`{ids}` array<int>, `{decoded}` string").fields])
    names = schema.names

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROUND_TRIP_ROWS):
                batch = whole.slice(at, ROUND_TRIP_ROWS)
                vocab = vocabulary(path)
                numbers = [np.concatenate([np.zeros(0, np.int32), *vocab.encode(v.as_py() or "")]) for v in batch.column(batch.num_columns - 1)]
                ends = np.cumsum([0, *map(len, numbers)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(numbers)))
                texts = pa.array(("".join(vocab.decode(n)) for n in numbers), pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists, texts], names=names)

    return rows.mapInArrow(each, schema)
