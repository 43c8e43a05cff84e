"""The tokenizers library, set up for tasks: encoding without truncation, padding, added tokens or threads."""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Callable

from trellis.llm.transducer import byte_letters


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


@functools.lru_cache(maxsize=2)
def word_merger(path: str) -> Callable[[bytes], list[int]] | None:
    """Ids of a single word's bytes by tiktoken's merge loop, for a byte-level vocabulary that it merges like the library.

    That loop merges neighbours whenever their join is a token, the one of the smallest id first; the library's merges
    pairs of its list, the first one first.  They agree if ids ascend along the list and every token is what the
    library makes of its own letters: inside the letters of a token merges then run as they do for the token alone,
    so the last pair is the one on the list.  Both are checked here; otherwise there is no merger.
    """
    import tiktoken

    loaded = tokenizer(path)
    model = json.loads(loaded.to_str())["model"]
    own, vocabulary = loaded.model, model["vocab"]
    added = {t.content for t in loaded.get_added_tokens_decoder().values()}
    numbers = {letter: byte for byte, letter in byte_letters().items()}
    words = {s: i for s, i in vocabulary.items() if s not in added}
    if not all(c in numbers for s in words for c in s) or not all(letter in words for letter in numbers):
        return None
    order = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if any(a >= b for a, b in zip(order, order[1:])) or any([t.id for t in own.tokenize(s)] != [i] for s, i in words.items()):
        return None
    ranks = {bytes(map(numbers.__getitem__, s)): i for s, i in words.items()}
    return tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


def encoder(path: str) -> Callable[[list[str]], list[list[int]]]:
    """Ids of each text.

    A space or line feed and letters up to U+024F are one word, or a line feed and a word, for a byte-level
    splitter; they are merged without it, in one call (``word_merger``) or by the library's model.
    """
    loaded = tokenizer(path)
    model = loaded.model
    letters = byte_letters()
    split = [w for w, _ in loaded.pre_tokenizer.pre_tokenize_str(" ab é\nc")]
    byte_level = loaded.normalizer is None and split == ["Ġab", "Ġ" + letters[0xC3] + letters[0xA9], "Ċ", "c"]
    feed = [t.id for t in model.tokenize("Ċ")]
    merge = word_merger(path) if byte_level else None
    tokenize = model.tokenize

    def merged(word: bytes) -> list[int]:
        return [t.id for t in tokenize("".join([letters[b] for b in word]))]

    merge = merge or merged

    def whole(texts: list[str]) -> list[list[int]]:
        """The library's ids; where the characters of a token lie, which takes it longer, is not asked."""
        return [e.ids for e in loaded.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(texts: list[str]) -> list[list[int]]:
        if not byte_level:
            return whole(texts)
        out: list = [None] * len(texts)
        rest = []
        for k, text in enumerate(texts):
            word = text[1:]
            if word.isalpha() and text[0] in " \n" and (word.isascii() or max(word) <= "\u024f"):
                out[k] = merge(text.encode()) if text[0] == " " else feed + merge(word.encode())
            else:
                rest.append(k)
        for k, ids in zip(rest, whole([texts[k] for k in rest]) if rest else []):
            out[k] = ids
        return out

    return encode
