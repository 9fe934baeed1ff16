from __future__ import annotations

import random
import re

import pytest

from semtab.llm.line_dedup import dedup_lines
from tests.conftest import rows


def plain(docs, min_lines=2, long_words=50):
    """Text and removed places of each ``(id, text)``, by looking at every run of every document in turn."""
    seen, out = set(), []
    for ident, text in sorted(docs, key=lambda d: (d[0] is None, d[0])):
        lines = (text or "").split("\n")
        body = [(k, line.strip(" \t\n\x0b\x0c\r")) for k, line in enumerate(lines)]
        body = [x for x in body if x[1]]
        gone = set()
        for i in range(len(body)):
            for n in {1, min_lines}:
                run = tuple(x[1] for x in body[i : i + n])
                if len(run) < n or (n < min_lines and len(re.findall(r"[^\x20\x09-\x0D]+", run[0])) < long_words):
                    continue
                if run in seen:
                    gone |= {x[0] for x in body[i : i + n]}
                seen.add(run)
        kept = "\n".join(line for k, line in enumerate(lines) if k not in gone)
        out.append((ident, kept if gone else text, sorted(gone)))
    return out


def test_whole_table(sample):
    docs = [(r["doc_id"], r["text"]) for r in sample.collect()]
    got = rows(dedup_lines(sample, removed_col="_gone"), "doc_id", "text", "_gone")
    want = plain(docs)
    assert got == sorted(want, key=repr)
    assert any(w[2] for w in want)


@pytest.mark.parametrize("min_lines", [1, 2, 3, 4])
def test_random_runs(make, min_lines):
    draw = random.Random(min_lines)
    docs = [(k, "\n".join(draw.choice(["a", "b", "c", "d e", " a ", "", "\t"]) for _ in range(draw.randrange(12)))) for k in range(40)]
    docs += [(100 + k, "\n".join(["x"] * k)) for k in range(6)]
    got = rows(dedup_lines(make(docs), min_lines, removed_col="gone"), "doc_id", "text", "gone")
    assert got == sorted(plain(docs, min_lines), key=repr)


def test_odd_rows(make):
    words = " ".join(f"w{k}" for k in range(50))
    long = "\n".join(f"line {k % 700} of {k // 1400}" for k in range(3_000))
    docs = [(4, None), (2, ""), (1, words), (3, f"{words}\nother"), (None, f"  {words} \nend"), (5, " ".join(words.split()[:49])), (6, " ".join(words.split()[:49])), (7, long), (8, "p\nq"), (8, "p\nq"), (9, "z\np\n\nq\ny")]
    got = rows(dedup_lines(make(docs, extra=True), removed_col="gone"), "doc_id", "text", "gone")
    want = plain([d for k, d in enumerate(docs) if d not in docs[:k]])
    assert sorted(set(map(repr, got))) == sorted(map(repr, want)) and len(got) == len(docs)
    assert dedup_lines(make(docs, extra=True)).columns == make(docs, extra=True).columns
    assert (9, "z\n\ny", [1, 3]) in got and (None, "end", [0]) in got and (8, "p\nq", []) in got


def test_empty_table(make):
    assert dedup_lines(make([])).collect() == []
