"""Language profiles, quality verdicts, quotes and the whole pipeline against plain slow versions."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import tiktoken

import corpus_pipeline
from tests.llm.test_brute import components, edits, shingles
from veilframe.llm import bpe, chat_quotes, decontaminate, language, quality_rules, secrets

SF = "/root/testdata/sf0.001"


def plain_bundle(text):
    t = f" {language.letters(text)} ".replace("  ", " ")
    out = np.zeros(language.SIZE)
    for i in range(len(t) - 2):
        v = np.ones(language.SIZE)
        for place, ch in enumerate(reversed(t[i : i + 3])):
            v = v * np.roll(language.letter_vector(ord(ch)).astype(float), place)
        out += v
    return out


def test_bundles_and_cosines():
    texts = ["The cat sat on the mat.", "Der Hund schläft im Garten", "x", "日本語 の 文", "aaaa aaaa 12 aaaa"]
    counts = [language.gram_counts(language.letters(t)) for t in texts]
    assert np.array_equal(language.bundles(counts), np.array([plain_bundle(t) for t in texts]))
    prototypes = {n: plain_bundle(t) for n, t in zip("ab", texts)}
    names, unit = language._names(prototypes)
    for t, (name, score) in zip(texts, language.predict_texts(texts, names, unit)):
        v = plain_bundle(t)
        cosines = {n: float(v @ p / np.linalg.norm(v) / np.linalg.norm(p)) for n, p in prototypes.items()}
        assert name == max(sorted(cosines), key=cosines.get) and abs(score - min(1, max(0, cosines[name]))) < 1e-9
    same = {"zz": prototypes["a"], "aa": prototypes["a"]}  # equal cosines: the first name
    assert language.predict_texts(texts[:1], *language._names(same))[0][0] == "aa"


def test_kept_is_what_no_rule_covers(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lexicon, rules = quality_rules.learn(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    assert rules
    d = spark.read.parquet(f"{SF}/documents.parquet")
    stats = quality_rules.base(d).select("doc_id", *(c.alias(n) for n, c in quality_rules.statistics(lexicon).items()))
    rows = {r.doc_id: r.asDict() for r in stats.collect()}
    got = quality_rules.judge(d, lexicon, rules).collect()
    assert len(got) == len(rows) and all(r.kept == (not r.base_failed and not any(x.holds(rows[r.doc_id]) for x in rules)) for r in got)


def test_rules_on_labels_not_seen(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    lexicon, rules = quality_rules.learn(docs, labels.where("doc_id % 4 <> 1"))
    bad = {r.doc_id: r.bad for r in quality_rules.labelled_sample(labels.where("doc_id % 4 = 1")).collect()}
    got = {r.doc_id: r.kept for r in quality_rules.judge(docs, lexicon, rules).where("NOT base_failed").collect()}
    same = [got[i] != bad[i] for i in bad if i in got]
    print(f"{sum(same)} of {len(same)}")
    assert len(same) > 50 and sum(same) >= 0.9 * len(same)


def test_many_quotes(spark):
    """Made-up threads with quotes of earlier turns, of other conversations and of nothing known."""
    rng, rows = random.Random(8), []
    passages = [f"passage {i} of some words" for i in range(60)]
    for conv in range(25):
        for turn in range(rng.randrange(1, 9)):
            lines = []
            for _ in range(rng.randrange(1, 5)):
                mark = rng.choice(["", "", "> ", "> > ", ">", " > > >"])
                lines += [mark + (rng.choice(passages).upper() if rng.random() < 0.3 else rng.choice(passages)), *[""] * rng.randrange(2)]
            rows.append((conv, turn + (turn > 3 and conv % 5 == 0), rng.choice("ua"), "\n".join(lines)))
    got = chat_quotes.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sum(r.n_linked for r in got) > 50
    assert sorted(map(tuple, got), key=str) == sorted(con.execute(chat_quotes.ORACLE).fetchall(), key=str)


def test_pipeline_equals_a_plain_chain(spark, tmp_path):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randrange(2, 9)))
    items = [(i, " ".join(word() for _ in range(rng.randrange(6, 14)))) for i in range(5)]
    rows = []
    for i in range(60):
        w = [word() for _ in range(rng.randrange(1, 120))]
        if rows and i % 3 == 0 and len(rows[-1][1].split()) > 20:  # a near copy
            w = rows[-1][1].split()
            w[rng.randrange(len(w))] = word()
        if i % 7 == 0:
            w[len(w) // 2 : len(w) // 2] = items[i % 5][1].replace(" ", "  ", 1).split(" ")
        if i % 11 == 0:
            w.append("token = Zx81" + "".join(rng.choice("abcXYZ019") for _ in range(24)))
        rows.append((i, " ".join(w), "en" if i % 2 else "fr", "s", 0))
    rows += [(60, None, "en", "s", 0), (61, "12 34 !!", "en", "s", 0), (62, rows[5][1].upper(), "fr", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    texts = {i: t for i, t, *_ in rows if t and any(map(str.isalpha, t))}
    root = components({i: shingles(t, 5) for i, t in texts.items()}, 80)
    texts = {i: t for i, t in texts.items() if root[i] == i}
    whole = [decontaminate.normal(t) for _, t in items]
    leaked = {i for i, t in texts.items() if any(edits(p, decontaminate.normal(t)) <= decontaminate.budget(len(p), 0.1) for p in whole)}
    texts = {i: secrets.mask(t, secrets.trained()) for i, t in texts.items() if i not in leaked}
    c = bpe.codec(bpe.read_ranks(f"{corpus_pipeline.TOKENIZERS}/byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=bpe.SPLIT, mergeable_ranks=c.ranks, special_tokens={})
    want = {}
    for i, t in texts.items():
        ids = np.array(own.encode_ordinary(t), "<u4")
        want[i] = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
    assert got == want and leaked and Counter("[SECRET]" in t for t in texts.values())[True] and len(root) > len(set(root.values()))
