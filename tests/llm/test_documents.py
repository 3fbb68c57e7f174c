"""Quality rules, language, toxicity, quality, sharding, near-duplicates and decontamination against brute force."""

import itertools
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from conftest import SMALL
from deltaloom.llm import decontamination, language_id, line_rules, minhash, quality, sharding, toxicity
from deltaloom.llm.common import table
from deltaloom.llm.kernels import Texts
from deltaloom.llm.sampling import sample

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t", "x", "a\n\na\na \n", "a b c d e f g h " * 3, "\n\n x", "é ñ\x0bü\x1c", "x" * 100_000, "word " * 30_000, "日本語 テキスト。\n日本語"]


def docs(spark):
    return table(spark, SMALL, "documents")


def odd(spark, more=()):
    rows = [(i, t, None if i % 2 else "en", "s", "clash") for i, t in enumerate([*ODD, *more])]
    return spark.createDataFrame([*rows, (None, "no id", None, None, None), rows[3], rows[3]], "doc_id long, text string, lang string, source string, id string")


def test_trimmed_words():
    t = Texts(pa.array(["(Hello), ... world!!", None, "--", "é."]))
    starts, ends, real = t.trimmed()
    assert [bytes(t.buf[a:b]).decode() for a, b in zip(starts[real], ends[real])] == ["Hello", "world", "é"]


def base_figures(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    n, r = len(w), len(covered)
    return {"n_words": n, "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": r, "base_failed": n < 20 or 100 * r > 30 * n}


def test_line_rules(spark):
    for source in (docs(spark), odd(spark)):
        rows = source.select("doc_id", "text").collect()
        want = sorted((str(r["doc_id"]), *base_figures(r["text"]).values()) for r in rows)
        got = line_rules.line_rules(source).collect()
        assert sorted((str(r["doc_id"]), *(r[k] for k in base_figures("").keys())) for r in got) == want
        assert all(not r["kept"] for r in got if r["base_failed"])


def test_cleaned_text(spark):
    good = "\n".join(" ".join(f"word{i}x{j}" for j in range(9)) + "." for i in range(6))
    bad = "Home | About | Contact | Help\nAll rights reserved by nobody in particular.\n!!! *** $$$ ###"
    df = spark.createDataFrame([(1, f"{good}\n{bad}\n{good.splitlines()[0]}", 0, "x"), (2, good, 5, "y"), (3, None, 0, "z"), (4, bad * 5, 1, "w")], "doc_id long, text string, n_chars long, c1 string")
    got = {r["doc_id"]: r for r in line_rules.cleaned(df).collect()}
    assert set(got) == {1, 2} and got[1]["text"] == good and got[1]["n_chars"] == len(good) and got[2]["text"] == good and got[1]["c1"] == "x"


def test_language(spark):
    model = language_id.train(docs(spark).where(~language_id.held_out()))
    out = language_id.predict(docs(spark).select("doc_id", "text", "lang"), model).toPandas()
    held = out.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)
    assert (out.lang_pred == out.lang)[held].mean() > 0.85  # some fifty texts; a larger table gives over 0.99
    assert out.score.between(0, 1).all()
    got = language_id.predict(odd(spark), model).collect()
    assert len(got) == len(ODD) + 3
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if not any(c.isalpha() for c in r["text"] or ""))
    clash = odd(spark).withColumn("score", language_id.F.lit("own")).withColumn("lang_pred", language_id.F.lit(1))
    kept = language_id.known(clash, model)
    assert kept.columns == clash.columns and kept.where("score <> 'own'").count() == 0 and 0 < kept.count() < clash.count()
    assert language_id.predict(clash, model).columns == [*odd(spark).columns, "lang_pred", "score"]
    none = language_id.train(odd(spark).where("lang = 'nowhere'"))
    assert none is None and language_id.predict(odd(spark), none).where("lang_pred <> 'und'").count() == 0


def test_windows_cover_every_byte():
    texts = Texts(pa.array(["", "a" * 5, "b" * 256, "c" * 257, "d" * 3000]))
    x, doc, length = language_id.text_windows(texts)
    assert Counter(doc.tolist()).keys() == {1, 2, 3, 4}
    for d, n in ((1, 5), (2, 256), (3, 257), (4, 3000)):
        own = length[doc == d]
        assert own[0] == min(n, 256) and (len(own) - 1) * language_id.STRIDE + own[-1] == n


def test_pair_tables_equal_the_network():
    net = language_id.Network(["a", "b"])
    x = np.random.default_rng(0).integers(0, language_id.CLASSES, (5, language_id.WINDOW))
    h = np.concatenate([np.maximum(net._responses(x, w).max(axis=1) + net.bias[i], 0) for i, w in enumerate(language_id.WIDTHS)], axis=1)
    z = h @ net.out + net.out_bias
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    assert np.allclose(net.pairs().probabilities(x.astype(np.uint8)), p, atol=1e-3)


def test_toxicity(spark):
    labels = table(spark, SMALL, "labels")
    insults = "you are an idiot and a moron , worthless scum and pathetic loser"
    calm = "the weather was mild and we walked along the river until evening"
    made = [(10_000 + i, f"{calm} {i} " + (insults if i % 2 else calm)) for i in range(200)]
    train = docs(spark).select("doc_id", "text").unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    marks = labels.select("doc_id", "toxic").unionByName(spark.createDataFrame([(i, i % 2) for i, _ in made], "doc_id long, toxic int"))
    model = toxicity.train([(t, int(i % 2)) for i, t in made] + sample(train, "doc_id", "toxic", "text", 200, labels=marks))
    probe = spark.createDataFrame([(1, f"{calm} {insults}"), (2, calm), (3, None), (4, ""), (5, "?!")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.toxicity(probe, model).collect()}
    assert got[1]["severity"] > got[2]["severity"] and all(got[i]["severity"] == 0 for i in (3, 4)) and not got[5]["toxic"]
    assert np.all(np.diff(model.thresholds) > 0)
    assert toxicity.train([]) is None and toxicity.toxicity(probe, None).where("toxic").count() == 0


def test_ordinal_regression_recovers_order():
    rng = np.random.default_rng(3)
    x = np.abs(rng.normal(size=(2000, 3)))
    grade = np.searchsorted([1.0, 2.0, 3.0], x @ [2.0, 0.0, 0.0] + rng.logistic(size=2000) * 0.2)
    model = toxicity.Ordinal(np.zeros(0, np.uint64), np.zeros((0, 3), bool))
    model.fit(x, grade)
    assert model.weights[0] > 5 * max(abs(model.weights[1]), abs(model.weights[2])) and np.all(np.diff(model.thresholds) > 0)


def test_quality(spark):
    model = quality.train(docs(spark), table(spark, SMALL, "labels"))
    out = quality.quality(docs(spark), model, host=quality.F.col("source"), path=quality.F.col("lang")).toPandas()
    truth = table(spark, SMALL, "labels").toPandas().merge(out, on="doc_id")
    assert ((truth.quality_x == 1) == truth.keep).mean() > 0.9
    assert quality.quality(odd(spark), model).count() == len(ODD) + 3
    assert quality.quality(odd(spark).limit(0), None).count() == 0


def test_sites_shrink_by_their_size(spark, monkeypatch):
    rows = [("big", "p", 0.1)] * 400 + [("big", "q", 0.9)] + [("small", "r", 0.1)] + [(f"h{i}", "x", 0.7 + i % 3 * 0.1) for i in range(300)]
    scored = spark.createDataFrame(rows, "host string, path string, p double")
    prior = quality.site_posteriors(scored).first()
    mu, kh, kp = prior["mu"], prior["kh"], prior["kp"]
    assert np.isclose(mu, np.mean([p for *_, p in rows]))
    # the whole posterior, each document without its own part in its sites
    monkeypatch.setattr(quality, "evidence", lambda *a: scored.selectExpr("1L AS id", "host", "path", "p"))
    logit = lambda x: np.log(x / (1 - x))
    got = sorted((r["host"], r["path"], round(r["p_document"], 9), round(r["host_mean"], 9), round(r["path_mean"], 9), round(r["quality"], 9)) for r in quality.quality(scored, None).collect())
    want, total = [], defaultdict(float)
    for h, q, p in rows:
        for k, v in (((h,), p), ((h, q), p), (("n", h), 1), (("n", h, q), 1)):
            total[k] += v
    for h, q, p in rows:
        host = (kh * mu + total[(h,)] - p) / (kh + total["n", h] - 1)
        path = (kp * host + total[h, q] - p) / (kp + total["n", h, q] - 1)
        want.append((h, q, round(p, 9), round(host, 9), round(path, 9), round(1 / (1 + np.exp(-(logit(p) + logit(path) - logit(mu)))), 9)))
    assert got == sorted(want)
    alone = {g[0]: g for g in got}["small"]
    assert np.isclose(alone[5], alone[2])  # a site of its own changes nothing


@pytest.mark.parametrize("limit", [1 << 20, 20_000, 3_000])
def test_sharding(spark, limit):
    source = docs(spark).unionByName(odd(spark).select("doc_id", "text", "lang", "source").withColumn("n_chars", sharding.F.lit(0).cast("long")))
    out = sharding.shards(source, limit).toPandas()
    assert len(out) == docs(spark).count() + len(ODD) + 3
    sums = out.groupby("shard_id").n_bytes.sum()
    single = out.groupby("shard_id").size() == 1
    assert ((sums <= limit) | single).all() and (out.groupby("shard_id").shard_bytes.first() == sums).all()
    names = sorted(s for s in out.shard_id.unique() if s.isdigit() or s == "")
    assert not any(b.startswith(a) for a, b in itertools.pairwise(names))
    # only oversized buckets were split: a shard's parent does not fit
    h = out.assign(bits=out.shard_id)
    for s in names:
        if s:
            assert out[out.shard_id.str.startswith(s[:-1]) & ~out.shard_id.str.endswith("!")].n_bytes.sum() > limit


def test_equal_rows_overflow(spark):
    df = spark.createDataFrame([(7, "x" * 100)] * 25, "doc_id long, text string")
    out = sharding.shards(df, 1000).toPandas()
    assert len(out) == 25 and out.groupby("shard_id").n_bytes.sum().max() <= 1000 and out.shard_id.nunique() == 3


def test_sharding_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = db.execute(sharding.ORACLE).fetchdf().sort_values("doc_id")
    got = sharding.shards(docs(spark)).toPandas().sort_values("doc_id")[want.columns]
    assert (want.astype(str).values == got.astype(str).values).all()


def components_by_force(rows, width, percent=80):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for r in rows:
        w = WORD.findall((r["text"] or "").translate(lower))
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    common = Counter()
    for own in where.values():
        common.update(itertools.combinations(own, 2))
    for (i, j), n in common.items():
        if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
            parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r["doc_id"]), r["doc_id"])
    return {r["doc_id"]: (len(sets[i]), least[find(i)]) for i, r in enumerate(rows)}


def mutated(seed=5):
    rng = np.random.default_rng(seed)
    base = [f"w{x}" for x in rng.integers(0, 500, 120)]
    out = []
    for i in range(120):
        w = list(base)
        for at in rng.integers(0, len(w), rng.integers(0, 9)):
            w[at] = f"z{rng.integers(0, 10**6)}"
        out.append(" ".join(w))
    return [*out, *["Exact Copy of a text with a few words"] * 40, *["exact copy OF a text with a few words"] * 3, "one", "one", "two words", "TWO words"]


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(spark, width):
    texts = [(1000 + i, t) for i, t in enumerate([*mutated(), None, "", "  "])]
    source = docs(spark).select("doc_id", "text").unionByName(spark.createDataFrame(texts, "doc_id long, text string"))
    rows = source.collect()
    want = components_by_force(rows, width)
    got = minhash.near_duplicates(source, width).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])


def test_near_duplicates_edges(spark):
    got = minhash.near_duplicates(odd(spark)).collect()
    assert len(got) == len(ODD) + 3
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, True)]
    assert len([r for r in got if r["doc_id"] == 3]) == 3
    assert minhash.near_duplicates(odd(spark).limit(0)).count() == 0
    same = spark.createDataFrame([(5, "a b c d e f g"), (5, "p q r s t u v"), (2, "p q r s t u v"), (9, "a b c d e f g")], "doc_id long, text string")
    assert {r["component_id"] for r in minhash.near_duplicates(same).collect()} == {2}


def test_circulant_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 900, dtype=np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 2**63, 100, dtype=np.uint64)])
    agree = np.mean(minhash.signature(np.unique(a), 512) == minhash.signature(np.unique(b), 512))
    assert abs(agree - 0.8) < 0.07


ITEMS = [
    (1, "A train leaves the old station at 9 and travels 60 km to meet Robert near the bridge before noon on a quiet sunday"),
    (2, "The committee of seven farmers decided that every field should be watered twice before the long harvest began again"),
    (3, "only three words"), (4, None), (5, ""),
]


def test_decontamination(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    pad = "Nothing in these words has to do with any of it, they only stand around here to fill the page. "
    cases = [
        (1, pad + ITEMS[0][1] + ". " + pad, {1}),
        (2, pad + ITEMS[0][1].replace("9", "11").replace("60", "85").replace("Robert", "Sandra") + ". " + pad, {1}),
        (3, pad + ITEMS[1][1].upper() + " " + pad, {2}),
        (4, pad * 3, set()),
        (5, None, set()),
        (6, "", set()),
        (7, ITEMS[1][1] + " " + ITEMS[0][1], {1, 2}),
        (8, pad + " ".join(ITEMS[1][1].split()[:5]) + " " + pad, set()),
    ]
    df = spark.createDataFrame([(i, t, "clash", "x") for i, t, _ in cases] + [(None, ITEMS[0][1], "c", "x")], "doc_id long, text string, item_id string, pos string")
    got = defaultdict(set)
    for r in decontamination.contaminated(df, bench).collect():
        got[r["doc_id"]].add(r["item_id"])
    assert dict(got) == {i: w for i, _, w in cases if w}
    assert decontamination.contaminated(df.limit(0), bench).count() == 0
    assert decontamination.contaminated(df, bench.limit(0)).count() == 0
    left = decontamination.without_contaminated(df, bench)
    assert left.columns == df.columns and left.count() == 5


def test_inconsistent_slots_are_another_text(spark):
    item = "first 5 apples then 5 pears then 5 plums were given to each of the many waiting children there"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    df = spark.createDataFrame([(1, item.replace("5", "8")), (2, item.replace("5", "8", 1).replace("5", "9", 1).replace("5", "7", 1))], "doc_id long, text string")
    assert [r["doc_id"] for r in decontamination.contaminated(df, bench).collect()] == [1]


def test_decontamination_without_broadcast(spark, monkeypatch):
    bench = table(spark, SMALL, "benchmark")
    want = sorted(map(tuple, decontamination.contaminated(docs(spark), bench).collect()))
    monkeypatch.setattr(decontamination, "MOST_BROADCAST", 0)
    assert sorted(map(tuple, decontamination.contaminated(docs(spark), bench).collect())) == want
    texts = {r["doc_id"]: " ".join((r["text"] or "").split()) for r in docs(spark).collect()}
    planted = {(i, b["item_id"]) for b in bench.collect() for i, t in texts.items() if " ".join(b["text"].split()) in t}
    assert planted and planted <= {(r[0], r[1]) for r in want}


def test_pipeline_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    clash = {c: language_id.F.lit(c) for c in ("id", "kept", "score", "lang_pred", "component_id", "length", "sequence_id", "p", "h", "clean_text")}
    rows = docs(spark).unionByName(odd(spark).select("doc_id", "text", "lang", "source").withColumn("n_chars", language_id.F.lit(None).cast("long"))).withColumns(clash)
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    table(spark, SMALL, "benchmark").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0
    rows.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    table(spark, SMALL, "benchmark").write.parquet(str(tmp_path / "none" / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality rules", "language ID", "near-dedup", "decontamination", "packing"]
    out = corpus_pipeline.run(spark, SMALL).toPandas()
    kept = {r["doc_id"] for r in line_rules.line_rules(docs(spark)).where("kept").collect()}
    assert len(out) and set(out.doc_id) <= kept
    assert out.groupby("sequence_id").length.sum().max() <= 2048
