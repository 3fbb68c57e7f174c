"""Cases in which an operator once did less than its whole job, and whole results against brute force."""

import re
import string
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from conftest import SMALL
from deltaloom.llm import decontamination, kernels, language_id, line_rules, minhash
from deltaloom.llm.common import table
from test_documents import components_by_force


def chained(groups, size, words, edits, seed=1):
    """Copies of copies: each is made from one of the six texts before it, so ends of a group are far apart."""
    rng = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        made = [[f"g{g}w{i}" for i in range(words)]]
        for k in range(1, size):
            t = list(made[rng.integers(max(0, k - 6), k)])
            for at in rng.choice(words, edits, replace=False):
                t[at] = f"g{g}k{k}e{at}"
            made.append(t)
        out += [" ".join(t) for t in made]
    return out


def test_chained_copies_stay_together(spark):
    source = spark.createDataFrame(list(enumerate(chained(25, 60, 100, 2))), "doc_id long, text string")
    want = components_by_force(source.collect(), 4)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(source, 4).collect()} == want


def test_numbers_names_and_short_items_are_found(spark):
    items = [(1, "What is 12 + 34 + 56 - 78 equal to?"), (2, "Yesterday Robert met Sandra and Michael near old Denver"), (3, "Gravity pulls downward")]
    texts = [(1, items[0][1]), (2, items[1][1].lower()), (3, "They say GRAVITY pulls downward, always."), (4, "Gravity downward pulls nothing here. What is the sum equal to?")]
    df = lambda rows, k: spark.createDataFrame(rows, f"{k} long, text string")
    got = decontamination.contaminated(df([(i, f"Words before it. {t} Words after it.") for i, t in texts], "doc_id"), df(items, "item_id")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(1, 1), (2, 2), (3, 3)]


def test_long_clean_lines_with_a_phrase_stay(spark):
    clean = " ".join(f"word{i}" for i in range(30)) + " is good in terms of its words."
    rows = [(1, clean), (2, f"{clean}\nAll rights reserved by nobody in particular.")]
    got = {r["doc_id"]: r["text"] for r in line_rules.cleaned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: clean, 2: clean}


def test_line_rules_sql(spark):
    """On generated rows, and on lines at the bound of a phrase's line."""
    line = lambda n: " ".join(f"word{i}" for i in range(n - 2)) + " log in."
    made = [(i, "\n".join([line(n), "Some words in a line that is long enough to end in a stop.", line(n + 1)])) for i, n in enumerate((line_rules.PHRASE_LINE - 1, line_rules.PHRASE_LINE, line_rules.PHRASE_LINE + 1))]
    documents = pd.DataFrame([*made, (7, None), (8, ""), (9, "Home | About | Log in | Help\n" * 3)], columns=["doc_id", "text"])
    sql = duckdb.connect()
    sql.register("documents", documents)
    want = sql.execute(line_rules.ORACLE).fetchdf()
    got = line_rules.line_rules(spark.createDataFrame(documents.astype(object).where(documents.notna(), None), "doc_id long, text string")).toPandas()
    assert want["n_boilerplate"].sum() > 0 and sorted(want.columns) == sorted(got.columns)
    key = sorted(got.columns)
    assert sorted(got[key].itertuples(index=False, name=None)) == sorted(want[key].itertuples(index=False, name=None))


def test_without_a_model_texts_with_a_letter_stay(spark):
    rows = [(1, "clean text"), (2, "日本語"), (3, None), (4, ""), (5, "12 + 3")]
    assert sorted(r["doc_id"] for r in language_id.known(spark.createDataFrame(rows, "doc_id long, text string"), None).collect()) == [1, 2]


def drifting(seed, families=40):
    """Groups whose last text has one link only, to the unchanged one of three shifted windows: far from the group's centre."""
    rng = np.random.default_rng(seed)
    out = []
    for f in range(families):
        long = [f"f{f}w{i}" for i in range(203 + 60)]

        def at(shift, edit, long=long):
            w = long[shift : shift + 203]
            if edit:
                w = list(w)
                w[rng.integers(0, 203)] = f"e{rng.integers(0, 10**9)}"
            return " ".join(w)

        out += [at(0, True) for _ in range(300)] + [at(20, k > 0) for k in range(30)] + [at(40, k > 0) for k in range(30)] + [at(60, False)]
    return out


def test_drifting_groups_lose_no_link(spark):
    rows = [(i, t) for i, t in enumerate(drifting(7, 12))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    per = 300 + 30 + 30 + 1
    last = {r["doc_id"]: r["component_id"] for r in got}
    assert all(last[f * per + per - 1] == last[f * per + per - 2] for f in range(12))


def canonical(text):
    """(kind, value) of each word, written anew from the operator's description."""
    fold = {c: c + 32 for c in range(0xC0, 0xDF) if c != 0xD7}
    lower = {c: c + 32 for c in range(65, 91)}
    marks, out = string.punctuation, []
    before = None  # the word before as it stands, and the line it is in
    for line, body in enumerate((text or "").translate(fold).split("\n")):
        for raw in re.findall(r"[^\x20\x09-\x0D]+", body):
            word = raw.strip(marks)
            value = word.translate(lower)
            if word:
                number = word[0] in "0123456789" or value in decontamination.NUMBER_WORDS
                inner = before is not None and before[1] == line and before[0][-1] not in ".!?:;"
                first, second = word.encode()[0], word.encode()[min(1, len(word.encode()) - 1)]
                name = not number and inner and 65 <= first <= 90 and len(word.encode()) > 1 and not 65 <= second <= 90
                unit = not number and bool(out) and out[-1][0] == 1 and value in decontamination.UNIT_WORDS
                out.append((1 if number else 3 if unit else 2 if name else 0, value))
            before = (raw, line)
    return out


def found_by_force(docs, items):
    """{(doc, item): (n_windows, n_slots, n_changed)} by comparing all windows."""
    out = {}
    words_of = {d: canonical(t) for d, t in docs}
    for item, text in items:
        words = canonical(text)
        width = min(8, len(words))
        if not width:
            continue

        def windows(ws, exact, width=width):
            for i in range(len(ws) - width + 1):
                w = ws[i : i + width]
                if exact:
                    yield i, tuple(v for _, v in w), ()
                elif 2 * sum(k == 0 for k, _ in w) > width:
                    yield i, tuple(v if k == 0 else k for k, v in w), tuple(v for k, v in w if k)

        for exact in (False, True):
            if not exact and width < 4:
                continue
            own = defaultdict(list)
            for i, key, slots in windows(words, exact):
                own[key].append((i, slots))
            total = sum(map(len, own.values()))
            for d, ws in words_of.items():
                lines = defaultdict(lambda: (set(), set()))
                for j, key, slots in windows(ws, exact):
                    for i, mine in own.get(key, ()):
                        lines[j - i][0].add(i)
                        lines[j - i][1].update(zip(mine, slots, strict=True))
                single = lambda p: len({b for b, _ in p}) == len(p)
                places, pairs = set(), set()
                for at, p in (v for _, v in sorted(lines.items(), key=lambda kv: (-len(kv[1][0]), kv[0])) if single(v[1])):
                    if single(pairs | p):
                        places, pairs = places | at, pairs | p
                if places and len(places) / total >= decontamination.COVERAGE and (d, item) not in out:
                    out[d, item] = (len(places), len(pairs), sum(a != b for a, b in pairs))
    return out


def as_found(rows):
    return {(r["doc_id"], r["item_id"]): (r["n_windows"], r["n_slots"], r["n_changed"]) for r in rows}


def test_decontamination_equals_brute_force(spark):
    bench = [(r["item_id"], r["text"]) for r in table(spark, SMALL, "benchmark").collect()]
    docs = [(r["doc_id"], r["text"]) for r in table(spark, SMALL, "documents").collect()]
    bench += [
        (9001, "Compute 12 plus 30 minus 7 times 2"), (9002, "What comes next 2 4 8 16 32 64 128"), (9003, "Lisa has 3 apples and Karl has 5 pears so how many fruits do Lisa and Karl hold together today"),
        (9004, "x"), (9005, ""), (9006, None), (9007, "Lisa has 3 apples and Karl has 5 pears so how many fruits do Lisa and Karl hold together today"),
    ]
    say = lambda a, x, b, y, c="Lisa": f"Well then, {a} has {x} apples and {b} has {y} pears so how many fruits do {c} and {b} hold together today"
    docs += [
        (9101, "So: compute 12 plus 30 minus 7 times 2!"), (9102, "And what comes next 2 4 8 16 32 64 128 then?"), (9103, say("Lisa", 3, "Karl", 5)), (9104, say("Anna", 4, "Omar", 6, "Anna")),
        (9105, say("Anna", 4, "Omar", 4, "Anna")), (9106, say("Anna", 4, "Omar", 6, "Berta")), (9107, None), (9108, say("Anna", 4, "Omar", 6, "Anna") + ". " + say("Eva", 9, "Paul", 8, "Eva") + "."),
        (9109, "x"), (9110, say("anna", 4, "omar", 6, "anna")), (9103, say("Lisa", 3, "Karl", 5)),
    ]
    df = lambda rows, k: spark.createDataFrame(rows, f"{k} long, text string")
    got = as_found(decontamination.contaminated(df(docs, "doc_id"), df(bench, "item_id")).collect())
    assert got == found_by_force(docs, bench)
    assert {(9101, 9001), (9102, 9002), (9103, 9003), (9104, 9003), (9105, 9003), (9108, 9003)} <= set(got)


@pytest.mark.parametrize("lower", [False, True])
def test_hashes_do_not_depend_on_blocks(monkeypatch, lower):
    column = pa.array(["Ab cd  Éf\n" * 40, None, "", "x" * 100, "Cd Ab"])
    whole = kernels.Texts(column).word_hashes(lower)
    for step in (1, 7, 64, len(kernels.Texts(column).buf)):
        monkeypatch.setattr(kernels, "HASH_BLOCK", step)
        assert (kernels.Texts(column).word_hashes(lower) == whole).all()


def test_repeated_ids_in_the_pipeline(spark):
    import corpus_pipeline

    rows = [(1, "a b c d e f g", "x"), (1, "h i j k l m n", "y"), (1, "a b c d e f g", "z"), (2, "o p q r s t u", "x"), (None, "a b c d e f g", "x"), (3, None, "x"), (3, None, "x")]
    df = lambda r: spark.createDataFrame(r, "doc_id long, text string, kept string")
    one = sorted(map(str, corpus_pipeline.near_dedup(spark, df(rows), SMALL).collect()))
    assert one == sorted(map(str, corpus_pipeline.near_dedup(spark, df(rows[::-1]), SMALL).collect()))
    assert len(one) == 5 and sum("doc_id=1," in x for x in one) == 1
