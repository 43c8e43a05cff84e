"""Surrogates for private data: keyed, of the same type and format, distinct, and the same wherever an entity returns.

Detection finds addresses, numbers and secrets by pattern and checksum, and names after a title, which states the
gender.  An entity is (kind, canonical form): spellings that differ in case or separators are one entity, and so
are a surname's mentions with and without a given name.  Its surrogate is drawn from an HMAC of the key and the
entity and written in each mention's own format: separators, lengths, letter case and script stay; card and account
numbers stay valid if they were; given names keep the gender.

Collisions.  The corpus's distinct entities combine before they are shuffled.  A surrogate that two entities of a
kind drew, or that is itself an entity of the corpus, is drawn again with the next attempt number.  What is left after
``RANDOM_ROUNDS`` gets free values of its format one to one, and of a wider format (one more character, another
range of addresses) once its own has none left.  First draws need no table: a task computes them where the text lies.  Only the entities that needed
another draw are looked up, from a broadcast up to ``MAX_REDRAWN`` of them and by a join per document beyond.
"""

from __future__ import annotations

import functools
import hashlib
import hmac
import json
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellis.llm.schema import extended
from trellis.llm.shipping import ship
from trellis.session import Staged, stage

MAX_REDRAWN, RANDOM_ROUNDS = 200_000, 8
#: Values of a format that are tried at first, and that a task lists at once.
TRIED, LISTED = 1024, 4096

# ---- fixed values: titles and the syllables that names are made of ---------------------------------
TITLES = {
    "Mr": "m", "Mister": "m", "Sir": "m", "Herr": "m", "Herrn": "m", "Monsieur": "m", "Señor": "m", "Signor": "m", "Господин": "m", "Κύριος": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Madam": "f", "Frau": "f", "Madame": "f", "Mademoiselle": "f", "Señora": "f", "Signora": "f", "Госпожа": "f", "Κυρία": "f",
    "Dr": "n", "Prof": "n", "Доктор": "n",
}
SYLLABLES = {
    "latin": ("b d f g h k l m n p r s t v br dr gr kl st tr".split(), "a e i o u".split(), {"m": ["o", "us", "er", "in"], "f": ["a", "ia", "ina", "elle"], "n": ["e", "is", "en"]}),
    "cyrillic": ("б в г д ж з к л м н п р с т бр гр ст".split(), "а е и о у".split(), {"m": ["ин", "ор", "ей"], "f": ["а", "ия", "ина"], "n": ["о", "ен"]}),
    "greek": ("β γ δ θ κ λ μ ν π ρ σ τ φ".split(), "α ε ι ο".split(), {"m": ["ος", "ης", "ας"], "f": ["α", "ια", "η"], "n": ["ου", "ω"]}),
}
# ----------------------------------------------------------------------------------------------------

_CAP = r"[^\W\d_a-z]"
PATTERN = re.compile(
    r"(?P<email>(?<![\w.%+-])[\w.%+-]+@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,})"
    r"|(?i:(?<!\w)(?:password|passwd|pwd|token|secret|api[_-]?key)[\"']?\s?[=:]\s?[\"']?)(?P<secret>[\w+/-]{6,})"
    r"|(?P<key>(?<!\w)(?:AKIA|ASIA)[A-Z0-9]{16}(?!\w))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w.])\d(?:[ -]?\d){12,18}(?!\w))"
    r"|(?P<phone>(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)|(?<![\w.])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w))"
    rf"|(?<!\w)(?P<title>{'|'.join(sorted(TITLES, key=len, reverse=True))})\.?[  ](?P<name>{_CAP}[^\W\d_]+(?:[ -]{_CAP}[^\W\d_]+){{0,2}})"
)
#: Whatever PATTERN finds has one of these, a title or a secret's name.
_HINT = re.compile(r"[\d@]|AKIA|ASIA")
_SECRET_HINT = re.compile(r"(?i)password|passwd|pwd|token|secret|api[_-]?key")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def iban_valid(compact: str) -> bool:
    moved = compact[4:] + compact[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdecimal())


def canonical(kind: str, mention: str) -> str | None:
    """The form that all spellings of an entity share; None if the mention is not of the kind after all."""
    if kind == "email":
        return mention.lower()
    if kind == "ip":
        return mention if all(int(p) < 256 for p in mention.split(".")) else None
    if kind == "card":
        number = _digits(mention)
        return number if luhn(number) and len(set(number)) > 1 else None
    if kind == "phone":
        number = _digits(mention)
        return number[1:] if len(number) == 11 and number[0] == "1" else number
    if kind == "iban":
        compact = mention.replace(" ", "")
        return compact if iban_valid(compact) else None
    if kind == "secret":
        return mention if any(c.isdecimal() for c in mention) else None
    if kind == "ssn":
        return _digits(mention)
    return mention.casefold() if kind[:4] in ("give", "surn") else mention


def entities(text: str) -> Iterator[tuple[str, int, int, str]]:
    """(kind, start, end, canonical form) of every entity, in order and without overlaps."""
    if not (_HINT.search(text) or any(t in text for t in TITLES) or _SECRET_HINT.search(text)):
        return
    at = 0
    while m := PATTERN.search(text, at):
        kind = m.lastgroup
        start, end = m.span(kind)
        at = max(end, m.start() + 1)
        if kind == "name":
            gender, place = TITLES[m["title"]], start
            words = re.split(r"([ -])", m["name"])
            for k, word in enumerate(words):
                if k % 2 == 0:
                    part = "surname" if k == len(words) - 1 else f"given_{gender}"
                    yield part, place, place + len(word), canonical(part, word)
                place += len(word)
            continue
        form = canonical(kind, text[start:end])
        if form is None:
            at = start + 1 if kind in ("card", "iban") and end - start < 40 else at
            while 0 < at < len(text) and text[at].isalnum() and text[at - 1].isalnum():
                at += 1
            continue
        yield kind, start, end, form


class Draw:
    """A keyed stream of choices for one entity and attempt."""

    def __init__(self, key: bytes, *what):
        self.key, self.seed, self.block, self.pool = key, "\x1f".join(map(str, what)), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hmac.new(self.key, f"{self.seed}\x1f{self.block}".encode(), hashlib.sha256).digest()
            self.block += 1
        value, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return value % n

    def pick(self, options):
        return options[self.below(len(options))]

    def digits(self, n: int, first: str = "0123456789") -> str:
        return "".join(self.pick(first if k == 0 else "0123456789") for k in range(n))

    def like(self, text: str) -> str:
        """Characters of the same sort: hexadecimal text stays so, letters keep case and script."""
        if re.fullmatch(r"[0-9a-f]+", text) and not text.isdecimal() and not text.isalpha():
            return "".join(self.pick("0123456789abcdef") for _ in text)
        return "".join(self._one(c) for c in text)

    def _one(self, c: str) -> str:
        if c.isdecimal():
            return self.pick("0123456789") if c.isascii() else chr(ord(c) - int(c) + self.below(10))
        if not c.isalpha():
            return c
        if c.isascii():
            return self.pick("abcdefghijklmnopqrstuvwxyz" if c.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        return self.pick(_same_sort(ord(c) >> 8, c.islower(), c.isupper()))


@functools.lru_cache(maxsize=None)
def _same_sort(block: int, lower: bool, upper: bool) -> list[str]:
    """Letters of a block of 256 code points with the same case."""
    letters = (chr(k) for k in range(max(block << 8, 0xC0), (block + 1) << 8))
    return [c for c in letters if c.isalpha() and c.islower() == lower and c.isupper() == upper]


def _script(word: str) -> str | None:
    c = word[0].lower()
    if c.isascii() or "à" <= c <= "ɏ":
        return "latin"
    return "cyrillic" if "а" <= c <= "ӿ" else "greek" if "ά" <= c <= "ώ" else None


def _name(draw: Draw, kind: str, word: str) -> str:
    script = _script(word)
    if script is None:
        return draw.like(word)
    onsets, vowels, endings = SYLLABLES[script]
    stem = "".join(draw.pick(onsets) + draw.pick(vowels) for _ in range(1 + draw.below(2) + (kind == "surname")))
    return stem + draw.pick(onsets) + draw.pick(endings[kind[-1] if kind.startswith("given") else "n"])


def surrogate(key: bytes, kind: str, form: str, attempt: int = 0) -> str:
    """Canonical form of an entity's surrogate."""
    draw = Draw(key, kind, form, attempt)
    if kind == "email":
        local, _, domain = form.partition("@")
        labels = domain.split(".")
        of_domain = Draw(key, "domain", domain)  # addresses of one domain stay together
        return draw.like(local) + "@" + ".".join([*(of_domain.like(x) for x in labels[:-1]), labels[-1]])
    if kind == "ip":
        first, second = form.split(".")[:2]
        private = {"10": 1, "192": 2 * (second == "168"), "127": 1}.get(first, 0)
        kept = form.split(".")[:private]
        head = [] if kept else [str(draw.pick([n for n in range(11, 224) if n not in (127, 172, 192)]))]
        return ".".join(kept + head + [str(1 + draw.below(254)) for _ in range(4 - len(kept + head))])
    if kind == "card":
        body = form[0] + draw.digits(len(form) - 2)
        return next(body + c for c in "0123456789" if luhn(body + c))
    if kind == "phone":
        return draw.digits(len(form), "23456789") if len(form) == 10 else form[: max(0, len(form) - 8)] + draw.digits(min(8, len(form)))
    if kind == "ssn":
        return draw.digits(9, "12345678")
    if kind == "iban":
        body = draw.like(form[4:])
        rest = int("".join(str(int(c, 36)) for c in body + form[:2] + "00")) % 97
        return f"{form[:2]}{98 - rest:02d}{body}"
    if kind == "key":
        return form[:4] + "".join(draw.pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in form[4:])
    return draw.like(form) if kind == "secret" else _name(draw, kind, form)


def slots(key: bytes, kind: str, form: str, wider: int = 0) -> list:
    """The choices whose combinations are all surrogates of an entity's format; ``wider`` steps beyond it."""
    digits, lower, base32 = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

    def one(c: str) -> str:
        if c.isdecimal():
            return digits if c.isascii() else "".join(chr(ord(c) - int(c) + k) for k in range(10))
        if not c.isalpha():
            return c
        return (lower if c.islower() else lower.upper()) if c.isascii() else "".join(_same_sort(ord(c) >> 8, c.islower(), c.isupper()))

    def like(text: str) -> list:
        if re.fullmatch(r"[0-9a-f]+", text) and not text.isdecimal() and not text.isalpha():
            return ["0123456789abcdef"] * len(text)
        return [one(c) for c in text]

    if kind == "email":
        return [*like(form.partition("@")[0]), *[lower] * wider, ["@" + surrogate(key, kind, form).partition("@")[2]]]
    if kind == "ip":
        first, second = form.split(".")[:2]
        kept = form.split(".")[: {"10": 1, "192": 2 * (second == "168"), "127": 1}.get(first, 0)]
        public = [str(n) for n in range(11, 224) if n not in (127, 172, 192)]
        heads = [[[p] for p in kept] or [public], [["10"]], [public]]
        if wider >= len(heads):
            raise RuntimeError("no free address is left")
        parts = [*heads[wider], *[[str(n) for n in range(1, 255)]] * (4 - len(heads[wider]))]
        return [x for p in parts for x in (["."], p)][1:]
    if kind == "card":
        return [form[0], *[digits] * (len(form) - 2 + wider)]
    if kind == "phone":
        own = ["23456789", *[digits] * 9] if len(form) == 10 else [*form[: max(0, len(form) - 8)], *[digits] * min(8, len(form))]
        return own + [digits] * wider
    if kind == "ssn":
        return ["12345678", *[digits] * (8 + wider)]
    if kind == "iban":
        return [[form[:2]], *like(form[4:]), *[digits] * wider]
    if kind == "key":
        return [[form[:4]], *[base32] * (len(form) - 4 + wider)]
    script = None if kind == "secret" else _script(form)
    if script is None:
        return like(form) + [one(form[-1]) if form[-1].isalpha() else lower] * wider
    onsets, vowels, endings = SYLLABLES[script]
    return [*[onsets, vowels] * (2 + (kind == "surname") + wider), onsets, endings[kind[-1] if kind.startswith("given") else "n"]]


def values_at(key: bytes, kind: str, choices: list, begin: int, end: int) -> Iterator[str]:
    """Combinations of ``slots`` in a keyed order; each comes once."""
    total = math.prod(map(len, choices))
    draw = Draw(key, "format", kind, json.dumps(choices))
    step, shift = (sum(draw.below(1 << 32) << 32 * k for k in range(total.bit_length() // 32 + 1)) for _ in range(2))
    while math.gcd(step, total) != 1:
        step += 1
    for place in range(begin, end):
        at, parts = (step * place + shift) % total, []
        for options in reversed(choices):
            at, k = divmod(at, len(options))
            parts.append(options[k])
        text = "".join(reversed(parts))
        if kind == "card":
            text = next(text + c for c in "0123456789" if luhn(text + c))
        if kind == "iban":
            rest = int("".join(str(int(c, 36)) for c in text[2:] + text[:2] + "00")) % 97
            text = f"{text[:2]}{98 - rest:02d}{text[2:]}"
        yield text


def render(kind: str, mention: str, form: str) -> str:
    """A surrogate in the format of a mention."""
    if kind in ("card", "phone", "ssn"):
        fresh, skip = iter(form), len(_digits(mention)) - len(form)  # a country code that is not part of the form stays
        return "".join(c if not c.isdecimal() or (skip := skip - 1) >= 0 else next(fresh) for c in mention) + "".join(fresh)
    if kind == "iban":
        fresh = iter(form)
        return "".join(c if c == " " else next(fresh) for c in mention) + "".join(fresh)
    if kind == "email" or kind.startswith(("given", "surname")):
        return form.upper() if mention.isupper() and len(mention) > 1 else form[0].upper() + form[1:] if mention[0].isupper() else form
    return form


def replace(text: str, choose: Callable[[str, str], str]) -> tuple[str, list[dict]]:
    """The text with every entity's surrogate, and the entities (kind, start, end in the original, surrogate)."""
    out, at, found = [], 0, []
    for kind, start, end, form in entities(text):
        new = render(kind, text[start:end], choose(kind, form))
        out += [text[at:start], new]
        at = end
        found.append({"kind": kind, "start": start, "end": end, "surrogate": new})
    return "".join(out) + text[at:], found


# ---- on Spark -------------------------------------------------------------------------------------

def corpus_entities(docs: DataFrame, text: str) -> DataFrame:
    """(kind, form): the distinct entities of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = list({(kind, form) for v in batch.column(0) for kind, _, _, form in entities(v.as_py() or "")})
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in own], pa.string()) for k in (0, 1)], names=["kind", "form"])

    return docs.select(text).mapInArrow(run, "kind string, form string").distinct()


def _drawn(rows: DataFrame, key: bytes, attempt: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [surrogate(key, k, f, attempt) for k, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], names=["kind", "form", "surrogate"])

    return rows.select("kind", "form").mapInArrow(run, "kind string, form string, surrogate string")


def distinct_surrogates(found: DataFrame, key: bytes) -> list[DataFrame]:
    """(kind, form, surrogate) by attempt: every surrogate distinct within its kind, and none an entity itself."""
    taken = found.select("kind", F.col("form").alias("surrogate"))
    rounds: list[DataFrame] = []
    left = found
    for attempt in range(RANDOM_ROUNDS):
        drawn = stage(_drawn(left, key, attempt))
        first = drawn.groupBy("kind", "surrogate").agg(F.min("form").alias("form"))  # of several, the smallest keeps it
        for other in (taken, *(r.select("kind", "surrogate") for r in rounds)):
            first = first.join(other, ["kind", "surrogate"], "left_anti")
        store = Staged(found.sparkSession)
        store.append(first.select("kind", "form", "surrogate"))
        rounds.append(store.last())
        store = Staged(found.sparkSession)
        n = store.append(drawn.select("kind", "form").join(rounds[-1].select("kind", "form"), ["kind", "form"], "left_anti"))["rows"]
        if not n:
            return rounds
        left = store.last()
    return [*rounds, *_assigned(left, [taken, *(r.select("kind", "surrogate") for r in rounds)], key)]


def _assigned(left: DataFrame, taken: list[DataFrame], key: bytes) -> list[DataFrame]:
    """(kind, form, surrogate) by round: free values of each entity's format, rank to rank by keyed hashes.

    A round tries the next values of a format, at least twice as many as it has entities and twice as many as the round
    before; a format without further values becomes wider.
    """

    def formats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [slots(key, r["kind"], r["form"], r["wider"]) for r in batch.to_pylist()]
            totals = [min(math.prod(map(len, x)), 1 << 62) for x in every]
            marks = [hmac.new(key, "\x1f".join(("rank", r["kind"], r["form"])).encode(), hashlib.sha256).digest() for r in batch.to_pylist()]
            made = [pa.array([hashlib.sha256(json.dumps(x).encode()).hexdigest() for x in every], pa.string()), pa.array(totals, pa.int64()), pa.array(marks, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=["kind", "form", "wider", "begin", "format", "total", "mark"])

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                choices = slots(key, r["kind"], r["like"]["form"], r["like"]["wider"])
                new = list(values_at(key, r["kind"], choices, r["at"], min(r["at"] + LISTED, r["end"])))
                marks = [hmac.new(key, f"free\x1f{x}".encode(), hashlib.sha256).digest() for x in new]
                same = [pa.array([r[c]] * len(new), t) for c, t in (("kind", pa.string()), ("format", pa.string()), ("begin", pa.int64()))]
                yield pa.RecordBatch.from_arrays([*same, pa.array(new, pa.string()), pa.array(marks, pa.binary())], names=["kind", "format", "begin", "surrogate", "mark"])

    group, rounds = ["kind", "format", "begin"], []
    left = left.select("kind", "form", F.lit(0).cast("long").alias("wider"), F.lit(0).cast("long").alias("begin"))
    ranked = F.row_number().over(Window.partitionBy(*group).orderBy("mark"))
    while True:
        rows = stage(left.mapInArrow(formats, "kind string, form string, wider long, begin long, format string, total long, mark binary"))
        tried = F.col("begin") + F.greatest(F.lit(TRIED), 2 * F.col("n")) * (1 << min(len(rounds), 40))
        groups = stage(rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.min("total").alias("total"), F.min(F.struct("form", "wider")).alias("like")).select(*group, "total", "like", F.least("total", tried).alias("end")))
        parts = groups.select(*group, "like", "end", F.explode(F.sequence("begin", F.col("end") - 1, F.lit(LISTED).cast("long"))).alias("at"))
        free = parts.repartition("kind", "format", "at").mapInArrow(values, "kind string, format string, begin long, surrogate string, mark binary")
        free = free.groupBy("kind", "surrogate").agg(F.min(F.struct("format", "begin", "mark")).alias("_of")).select("kind", "surrogate", "_of.*")
        for other in (*taken, *(r.select("kind", "surrogate") for r in rounds)):
            free = free.join(other, ["kind", "surrogate"], "left_anti")
        free = free.withColumn("rank", ranked).select(*group, "rank", "surrogate")
        rounds.append(stage(rows.withColumn("rank", ranked).join(free, [*group, "rank"]).select("kind", "form", "surrogate")))
        rest = rows.drop("total").join(rounds[-1].select("kind", "form"), ["kind", "form"], "left_anti").join(groups.drop("like"), group)
        done = F.col("end") >= F.col("total")
        store = Staged(rows.sparkSession)
        rest = rest.select("kind", "form", F.when(done, F.col("wider") + 1).otherwise(F.col("wider")).alias("wider"), F.when(done, 0).otherwise(F.col("end")).cast("long").alias("begin"))
        if not store.append(rest)["rows"]:
            return rounds
        left = store.last()


def surrogates(docs: DataFrame, key: bytes, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), max_redrawn: int = MAX_REDRAWN) -> DataFrame:
    """``keep`` columns, the text with surrogates, n_entities and entities (kind, start, end, surrogate) of every row.

    A text without entities is unchanged; null stays null.  Rows may repeat and get the same surrogates; other columns are
    ignored; an empty table gives an empty result.  Keys must be kept secret: whoever has one can test guesses.
    """
    spark = docs.sparkSession
    ship(spark)
    found = stage(corpus_entities(docs, text))
    again = None
    for rows in distinct_surrogates(found, key)[1:]:
        again = rows if again is None else again.unionByName(rows)
    n = 0 if again is None else again.count()
    names = list(keep)
    picked = docs.select(*names, F.col(text).alias("_text"))
    redrawn = {}
    if n and n <= max_redrawn:
        redrawn = {(r.kind, r.form): r.surrogate for r in again.collect()}
    shared = spark.sparkContext.broadcast(redrawn)
    if n > max_redrawn:
        picked = _with_redrawn(picked, names, again)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("surrogate", pa.string())])
        for batch in batches:
            texts, lists = [], []
            for k, value in enumerate(batch.column(len(names))):
                own = shared.value
                if batch.num_columns > len(names) + 1:
                    own = {(r["kind"], r["form"]): r["surrogate"] for r in batch.column(len(names) + 1)[k].as_py() or ()}
                old = value.as_py()
                new, spans = replace(old or "", lambda kind, form: own.get((kind, form)) or surrogate(key, kind, form))
                texts.append(new if old is not None else None)
                lists.append(spans)
            made = [pa.array(texts, pa.string()), pa.array(map(len, lists), pa.int64()), pa.array(lists, pa.list_(kind))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *made], names=[*names, text, "n_entities", "entities"])

    made = f"`{text}` string, n_entities long, entities array<struct<kind: string, start: long, end: long, surrogate: string>>"
    return picked.mapInArrow(run, extended(picked.schema.fields[: len(names)], made))


def _with_redrawn(picked: DataFrame, names: list[str], again: DataFrame) -> DataFrame:
    """Rows with the redrawn entities of their own text, met by the text's digest."""
    rows = picked.withColumn("_digest", F.sha2(F.coalesce("_text", F.lit("")), 256))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = {(d, kind, form) for d, v in zip(batch.column(0).to_pylist(), batch.column(1)) for kind, _, _, form in entities(v.as_py() or "")}
            yield pa.RecordBatch.from_pylist([{"_digest": d, "kind": k, "form": f} for d, k, f in own], schema=pa.schema([(c, pa.string()) for c in ("_digest", "kind", "form")]))

    mentions = rows.select("_digest", "_text").mapInArrow(run, "_digest string, kind string, form string").distinct()
    lists = mentions.join(again, ["kind", "form"]).groupBy("_digest").agg(F.collect_list(F.struct("kind", "form", "surrogate")).alias("_redrawn"))
    return rows.join(lists, "_digest", "left").select(*names, "_text", "_redrawn")
