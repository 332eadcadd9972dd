"""Repeated chunks of lines."""

import random
from collections import defaultdict

from riskloom.llm import lines

PASSAGE = [f"line {k} of a passage that many documents share" for k in range(7)]
LONG = " ".join(f"w{k}" for k in range(60))


def plain_dedup(texts):
    """Texts by distinct id, without the chunks that stand elsewhere before, by the lines themselves."""
    split = {d: (t or "").split("\n") for d, t in texts.items()}
    words = lambda x: x.count(" ") + 1
    places, last, after = defaultdict(list), defaultdict(set), defaultdict(set)
    for d, ls in split.items():
        for k, pair in enumerate(zip(ls, ls[1:])):
            places[pair].append((d, k))
            last[pair].add(ls[k - 1] if k else None)
            after[pair].add(ls[k + 2] if k + 2 < len(ls) else None)
    chunks = defaultdict(list)
    for d, ls in split.items():
        pairs, at = list(zip(ls, ls[1:])), 0
        while at < len(pairs):
            end = at + 1
            if len(places[pairs[at]]) > 1:
                while end < len(pairs) and len(after[pairs[end - 1]]) == len(last[pairs[end]]) == 1:
                    end += 1
                if sum(map(words, ls[at : end + 1])) >= 12:
                    chunks["\n".join(ls[at : end + 1])].append((d, at, end + 1))
            at = end
        for k, x in enumerate(ls):
            if words(x) >= 50:
                chunks[x].append((d, k, k + 1))
    gone, stays = set(), set()
    for where in chunks.values():
        first = min(where)
        if len(where) > 1:
            for d, a, b in where:
                (stays if (d, a, b) == first else gone).update((d, k) for k in range(a, b))
    gone -= stays
    cut = {d: "\n".join(x for k, x in enumerate(ls) if (d, k) not in gone) for d, ls in split.items()}
    return {d: None if texts[d] is None else cut[d] for d in texts}


def deduped(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return {r.doc_id: r.text for r in lines.dedup_lines(docs).collect()}


def test_passages_go_but_for_the_first(spark):
    own = lambda d: [f"only document {d} has line {k} of this" for k in range(4)]
    texts = {d: "\n".join(own(d)[:d] + PASSAGE + own(d)[d:]) for d in range(4)}
    texts |= {10: LONG, 11: "head\n" + LONG + "\ntail", 12: "tail", 13: None, 14: "", 15: "\n\n\n", 16: "x\n" * 3000}
    rows = [(d, t, 1, "n") for d, t in texts.items()] + [(None, LONG, 1, "n"), (12, "tail", 1, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cuts int, kept string")
    got = {(r.doc_id, r.text): r for r in lines.dedup_lines(docs).collect()}
    kept = {d: t for d, t in got}
    assert kept[0] == texts[0]
    for d in (1, 2, 3):
        assert kept[d] == "\n".join(own(d))
    assert kept[10] == LONG and kept[11] == "head\ntail" and kept[12] == "tail"
    assert kept[13] is None and kept[14] == "" and kept[15] == "\n\n\n" and kept[None] == "" and kept[16] == texts[16]
    assert got[3, kept[3]].n_removed == 7 and got[3, kept[3]].n_lines == 11
    assert len({(d, t) for d, t in got}) == len(texts) + 1 and lines.dedup_lines(docs).count() == len(rows)
    assert lines.dedup_lines(docs).columns == ["doc_id", "text", "cuts", "kept", "n_lines", "n_removed"]
    assert lines.dedup_lines(docs.limit(0)).count() == 0


def test_repeats_inside_one_text_and_repeated_rows(spark):
    between = "a line of its own between the two"
    text = "\n".join([*PASSAGE, between, *PASSAGE])
    docs = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    assert [r.text for r in lines.dedup_lines(docs).collect()] == ["\n".join([*PASSAGE, between])] * 2
    docs = spark.createDataFrame([(1, "\n".join(PASSAGE))] * 3, "doc_id long, text string")
    assert [r.text for r in lines.dedup_lines(docs).collect()] == ["\n".join(PASSAGE)] * 3


def test_passages_go_between_other_repeated_lines(spark):
    boiler = [f"boilerplate number {k}" for k in range(40)]
    texts = {}
    for at, (n, words) in enumerate([(2, 30), (4, 15), (6, 10), (12, 10), (20, 10), (7, 3)]):
        passage = [" ".join([f"p{at}l{k}", *["of"] * (words - 1)]) for k in range(n)]
        for d in range(3):
            near = boiler[at * 6 + d * 2 : at * 6 + d * 2 + 2]
            texts[at * 10 + d] = "\n".join([near[0], *passage, near[1]])
    texts[100] = "\n".join(boiler[::-1])
    got = deduped(spark, texts)
    for d, text in texts.items():
        whole = text.split("\n")
        assert got[d] == "\n".join(whole if d % 10 == 0 else [whole[0], whole[-1]])


def test_passages_that_overlap_stay_whole_somewhere(spark):
    a, b, c, d = (f"{x} " * 20 + "end" for x in "abcd")
    texts = {1: f"{a}\n{b}", 2: f"{a}\n{b}\n{c}", 3: f"{b}\n{c}", 4: f"{b}\n{c}\n{d}"}
    got = deduped(spark, texts)
    assert got == {1: f"{a}\n{b}", 2: f"{b}\n{c}", 3: "", 4: d} == plain_dedup(texts)


def test_random_lines(spark):
    rng = random.Random(2)
    some = [f"{k} one two three four five six" for k in range(12)] + ["", "x", LONG]
    texts = {}
    for d in range(150):
        ls = rng.choices(some, k=rng.randint(0, 5))
        if d and rng.random() < 0.5:
            other = texts[rng.randrange(d)].split("\n")
            at = rng.randrange(len(other))
            ls += other[at : at + rng.randint(1, 6)]
        texts[d] = "\n".join([*ls, *(f"own {d} {k}" for k in range(rng.randint(0, 2)))])
    want = plain_dedup(texts)
    assert deduped(spark, texts) == want and sum(want[d] != t for d, t in texts.items()) > 30
