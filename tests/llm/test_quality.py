"""Quality rules against a plain evaluation of their definitions."""

import random
import re
from collections import Counter

from trellis.llm.quality import RULES, STOP_WORDS, Rule, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    inside = {p for i, w in enumerate(windows) if often[w] > 1 for p in (i, i + 1, i + 2)}
    lines = [row for row in text.split("\n") if WORD.search(row)]
    m = {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(inside), "n_lines": len(lines),
        "n_stop_words": sum(w.lower() in STOP_WORDS and w in (w.lower(), w.upper(), w[0].upper() + w[1:].lower()) for w in words),
        "n_bullet_lines": sum(row.lstrip(" ").startswith(("-", "*", "•")) for row in lines),
        "n_cut_lines": sum(row.rstrip(" ").endswith(("...", "…")) for row in lines),
    }
    failed = m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]
    ratios = [
        300 * m["n_words"] <= 100 * m["word_chars"] <= 1000 * m["n_words"], 100 * m["n_symbols"] <= 10 * m["n_words"], 100 * m["n_stop_words"] >= 2 * m["n_words"],
        100 * m["n_dup_lines"] <= 50 * m["n_lines"], 100 * m["n_bullet_lines"] <= 90 * m["n_lines"], 100 * m["n_cut_lines"] <= 30 * m["n_lines"],
    ]
    return m, failed, not failed and all(ratios)


def texts():
    rng = random.Random(2)
    vocabulary = ["the", "The", "of", "and", "Für", "der", "alpha", "beta", "gamma,", "größe", "x" * 30, "#tag", "$5", "a|b", "...", "–", "\U0001f600", "-", "*", "•"]
    out = [None, "", " ", "\n\n", "\x0b\x0c", "one", "a a a a", "a b c a b c", "a b a b a", "x\ny\nx\ny\n", "same line\nsame line \nsame line"]
    for n in (2, 49, 50, 51, 120, 400):
        for _ in range(6):
            some = rng.sample(vocabulary, rng.choice([3, 8, 20]))
            out.append("".join(rng.choice(some) + rng.choice([" ", " ", "  ", "\n", "\t", "\r\n", " ", " "]) for _ in range(n)))
    out.append("- the item of a list\n" * 30)
    out.append("and so it is cut off here ...\n" * 3 + "the rest of the page is whole and long enough to be kept\n" * 2 + " ".join(f"word{k} the" for k in range(40)))
    out.append(" ".join(f"word{k} of" for k in range(100_000)))  # very long, nothing repeated
    out.append("the very same words " * 50_000)  # very long, all repeated
    return out


def test_quality(spark):
    rows = [(k, t, "n_words", 3) for k, t in enumerate(texts())]
    rows += [(0, rows[20][1], "", 0), (None, rows[21][1], "", 0), rows[5]]  # repeated and null ids, a repeated row
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string, one int").repartition(4)  # other columns with clashing names
    want = Counter()
    for k, t, _, _ in rows:
        m, failed, kept = plain(t)
        want[k, tuple(sorted(m.items())), failed, kept] += 1
    got = Counter((r.doc_id, tuple(sorted((n, r[n]) for n in plain("")[0])), r.base_failed, r.kept) for r in quality(docs).collect())
    assert got == want
    assert quality(docs.limit(0)).count() == 0


def test_rules_are_a_table(spark):
    docs = spark.createDataFrame([(1, "the cat # sat\n# the mat"), (2, "the cat sat")], "doc_id long, text string")
    found = {r.doc_id: r for r in quality(docs, base=(), rules=[Rule("few symbols", "n_symbols", "n_lines", high=50), RULES[0]]).collect()}
    assert (found[1].broken_rules, found[1].kept, found[1].base_failed) == (["few symbols", "word length"], False, False)
    assert found[2].broken_rules == [] and found[2].kept


def test_one_projection(spark):
    """No Python, no shuffle."""
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = quality(docs)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert not re.search("Python|Pandas|Arrow|Exchange|Aggregate|Join|Generate", plan), plan
