"""Operators against plain slow versions."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from veilframe.llm import bpe, chat_quotes, decontaminate, html_extract, language, near_dedup, secrets, substring_dedup, token_files

SF = "/root/testdata/sf0.001"


def components(sets, percent):
    """Least id reachable over links of all pairs."""
    ids, root = sorted(sets), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def test_near_dedup_with_a_large_group(spark, monkeypatch):
    """150 edited copies of one text, half of them near the threshold, others, and exact copies."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(9999)}" for _ in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(i, " ".join(f"y{rng.randrange(400)}" for _ in range(rng.randrange(1, 60)))) for i in range(150, 300)] + [(300, rows[7][1].upper())]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    assert got == components({i: shingles(t, 4) for i, t in rows}, 80)
    monkeypatch.setattr(near_dedup, "STRAYS", 2)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows[:150], "doc_id long, text string"), 4).collect()}
    assert got == components({i: shingles(t, 4) for i, t in rows[:150]}, 80)


@pytest.mark.parametrize(("kinds", "size", "rows"), [(512, 4_000_000, 4096), (1, 4_000_000, 1), (512, 40, 4096)])
def test_substring(spark, monkeypatch, kinds, size, rows):
    monkeypatch.setattr(substring_dedup, "KINDS", kinds)
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", size)
    monkeypatch.setattr(substring_dedup, "HEAVY", 1_000_000)
    monkeypatch.setattr(substring_dedup, "HEAVY_ROWS", rows)  # with 1 all keys are dealt
    monkeypatch.setattr(substring_dedup, "SALTS", 3)
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for i in range(40):
        w = [f"v{rng.randrange(30)}" for _ in range(rng.randrange(0, 60))]
        at = rng.randrange(len(w) + 1)
        rows.append((i, " ".join(w[:at] + passage[rng.randrange(10) : rng.randrange(10, 30)] + w[at:]) + " a b a b a b a b" * (i % 7 == 0)))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 5, 3).collect()}
    words = {i: t.split() for i, t in rows}
    times = Counter(tuple(w[i : i + 5]) for w in words.values() for i in range(len(w) - 4))
    for i, w in words.items():
        gone = {j for k in range(len(w) - 4) if times[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        assert got[i] == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_bpe_equals_the_library():
    import tiktoken

    from veilframe.llm.queries import TOKENIZERS

    c = bpe.codec(bpe.read_ranks(f"{TOKENIZERS}/byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=bpe.SPLIT, mergeable_ranks=c.ranks, special_tokens={})
    rng = random.Random(2)
    alphabet = "ab e'ts ré\n\t \u0085\x1c=1²½_中文\U0001f600 İſ<|endoftext|>"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(500)] + ["a" * 300, " " * 501, "the" * 200, "abcab" * 60, "x" * 2001, *("".join(rng.choice(abc) for _ in range(3000)) for abc in ("ab", "etaoinshr", "abcdefghijklmnopqrstuvwxyz", "=-_*#", "\u00e9\u00fca")), "=" * 3001]
    ids = c.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [own.encode_ordinary(t) for t in texts]
    assert c.decode(ids) == [t.encode() for t in texts]


def test_a_word_of_200000_letters():
    import resource
    import time

    from veilframe.llm.queries import TOKENIZERS

    c = bpe.codec(bpe.read_ranks(f"{TOKENIZERS}/byte_bpe_50k.tiktoken"))
    word = "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz", k=200_000))
    began, before = time.process_time(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    ids = c.encode([word, "x" * 200_000])
    assert time.process_time() - began < 40 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000
    assert c.decode(ids) == [word.encode(), b"x" * 200_000]


def test_token_files_equal_the_library(spark):
    import zlib

    from tokenizers import Tokenizer

    from veilframe.llm.queries import TOKENIZERS

    with open(f"{TOKENIZERS}/byte_bpe_50k.json", encoding="utf-8") as f:
        model = f.read()
    t = Tokenizer.from_str(model)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    files = token_files.write_tokens(docs, model, shards=3)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_tokens(files).collect()}
    at = 0
    for r in docs.orderBy("doc_id").collect():
        ids = np.array([*t.encode(r.text, add_special_tokens=False).ids, 0], "<u4")
        assert got[r.doc_id] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_files.Reader(files.folder).get(r.doc_id).tolist() == ids.tolist()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoders_equal_the_library(name):
    """Strings of special tokens, a model that splits and normalises otherwise, and two widths in one worker."""
    from tokenizers import Tokenizer

    from veilframe.llm.queries import TOKENIZERS

    with open(f"{TOKENIZERS}/{name}", encoding="utf-8") as f:
        model = f.read()
    t = Tokenizer.from_str(model)
    texts = ["abc <|endoftext|> def", "<|startoftext|>", "Plain  TEXT, it's 42\u00b2", None, "", "x <|endoftext|><|endoftext|>\n", "\u00e9t\u00e9 \u4e2d\u6587"]
    for width in (2, 4, 2):
        got = token_files._encoder(model, width).encode(texts)
        assert [np.frombuffer(x, f"<u{width}").tolist() for x in got] == [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def byte_model():
    from tokenizers import Tokenizer

    from veilframe.llm.queries import TOKENIZERS

    with open(f"{TOKENIZERS}/byte_bpe_50k.json", encoding="utf-8") as f:
        model = f.read()
    return model, Tokenizer.from_str(model)


def test_cuts_equal_the_library():
    """White space, contractions and blanks next to any class, at the ends of texts too; letters that only a Python library's Unicode knows."""
    model, t = byte_model()
    rng = random.Random(7)
    letters = "aZ''''strevmdl  \n\t\r 　\u0085\x00\x1c19²½.,-é中́\U0001f600\U00020000’<|"
    texts = ["".join(rng.choices(letters, k=rng.choice([1, 2, 3, 5, 8, 30]))) for _ in range(4000)]
    texts += ["a࢏1౜.՘", "x࢏࢏", "it's 'tis we'll they're I've '", "'re", "''ll", None, "", "  ", "a  \n b"]
    for at in range(0, len(texts), 100):
        for text, ids in zip(texts[at : at + 100], token_files._encoder(model, 2).encode(texts[at : at + 100])):
            assert np.frombuffer(ids, "<u2").tolist() == t.encode(text or "", add_special_tokens=False).ids, text


def test_rare_words_cost_less_than_a_call_each():
    """At most 0.7 of the CPU seconds that the library takes for each distinct piece by itself; before, all of it and the join."""
    import time

    model, t = byte_model()
    rng = random.Random(3)
    words = [" " + "".join(rng.choices(["er", "an", "the", "isch", "ou", "tion", "st", "ing", "a", "el"], k=rng.randint(3, 6))) for _ in range(60_000)]
    texts = ["".join(words[i : i + 500]) for i in range(0, len(words), 500)]
    pieces, encoder = sorted(set(words)), token_files.Encoder(model, 2)
    began = time.process_time()
    for i in range(0, len(pieces), 5000):
        for e in getattr(t, "encode_batch_fast", t.encode_batch)(pieces[i : i + 5000], add_special_tokens=False):
            assert e.ids
    between = time.process_time()
    got = encoder.encode(texts)
    assert time.process_time() - between < 0.7 * (between - began)
    assert np.frombuffer(got[7], "<u2").tolist() == t.encode(texts[7], add_special_tokens=False).ids


def test_token_files_with_a_hot_id(spark):
    """Rows of one id over several shards, null ids, and a file left by an earlier attempt."""
    from veilframe.llm.queries import TOKENIZERS

    with open(f"{TOKENIZERS}/byte_bpe_50k.json", encoding="utf-8") as f:
        model = f.read()
    rows = [(5, f"row {i}") for i in range(400)] + [(None, f"none {i}") for i in range(50)] + [(i, "one") for i in range(6, 20)]
    files = token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), model, shards=8)
    assert sum(n > 0 for n in token_files.layout(files.folder)["shards"]) > 4
    r = token_files.read_tokens(files).orderBy("start").collect()
    assert [x.doc_id for x in r] == sorted((i for i, _ in rows), key=lambda i: -1 if i is None else i) and all(b.start == a.start + a.n_tokens for a, b in zip(r, r[1:]))
    reader = token_files.Reader(files.folder)
    assert len({reader.get(5, c).tobytes() for c in range(400)}) == 400 and len({reader.get(None, c).tobytes() for c in range(50)}) == 50
    with pytest.raises(KeyError):
        reader.get(5, 400)
    token_files._put(files.folder, "shards.json", [b"again"])
    token_files._put(files.folder, "shards.json", [b"and again"])


def test_perfect_hash_is_minimal():
    h = token_files.key_hash(np.arange(5000), np.zeros(5000, np.int64))
    assert sorted(token_files.PerfectHash.build(h).slots(h).tolist()) == list(range(5000))
    assert (token_files.PerfectHash.build(h[:1]).slots(h[:1]) == 0).all()


def edits(pattern, text):
    before = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        now = [i]
        for j, b in enumerate(text, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (a != b)))
        before = now
    return min(before)


def test_leaks_equal_all_alignments():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    items = [(i, " ".join(word() for _ in range(rng.randrange((1, 2, 4, 8)[i % 4], 30 if i % 4 > 1 else 5)))) for i in range(12)]
    index = decontaminate.Index(items, 0.1, 8)
    for n in range(80):
        i, p = items[n % 12]
        s, e = list(p), decontaminate.budget(len(p), 0.1)
        for _ in range(rng.randrange(e + 4)):
            at = rng.randrange(len(s) + 1)
            s[at : at + rng.randrange(2)] = rng.choice(["a", "", "xy"])
        text = decontaminate.normal(" ".join(word() for _ in range(9)) + " " + "".join(s) + " " + " ".join(word() for _ in range(9)))
        got = {x: d for x, _, _, d in index.matches(decontaminate.codes(text))}
        want = {x: d for x, (_, q) in enumerate(items) if len(q) >= 8 and (d := edits(q, text)) <= decontaminate.budget(len(q), 0.1)}
        assert got == want | {x: 0 for x, (_, q) in enumerate(items) if len(q) < 8 and f" {q} " in f" {text} "}


def test_leaks_have_their_places(spark):
    """start, end and edits of planted copies, each in its own surroundings, and an item that comes twice."""
    items = [(1, "How many moons does the planet Mars have?"), (2, "yes it is"), (3, "It is 42"), (3, "How many moons does the planet Mars have?")]
    texts = ["Before. HOW MANY moons -- does the planet Mars have?! After", "x How many mooons does the planet Mars have y How many moons does the planet Mars have z", "so it is 42.", "it is 421", "oh YES, it is", "yesit is"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id, texts[r.doc_id][r.start : r.end], r.edits) for r in decontaminate.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect())
    whole = "How many moons does the planet Mars have"
    assert got == sorted([*((0, i, "HOW MANY moons -- does the planet Mars have", 0) for i in (1, 3)), *((1, i, t, e) for i in (1, 3) for t, e in ((whole, 0), ("How many mooons does the planet Mars have", 1))), (2, 3, "it is 42", 0), (3, 3, "it is 421", 0), (4, 2, "YES, it is", 0)])
    kept = decontaminate.without_leaks(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert [tuple(r) for r in kept.collect()] == [(5, "yesit is")]


def test_leaks_of_one_letter():
    """Hits by the million are counted in turns."""
    import resource

    index, before = decontaminate.Index([(1, "a" * 300)], 0.1, 8), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found = index.matches(decontaminate.codes("a" * 80_000))
    assert len(found) >= 200 and all(x[3] == 0 for x in found) and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000


def test_secret_base_equals_plain_patterns():
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    rng = random.Random(10)
    parts = ["token", "API_KEY", "=", ": ", '"', "AKIA", "AKIA" + "B7" * 8, "0123456789abcdef" * 2, "abc", " ", "pass", "password", "xyz123", "ſecret=abcdef", "\n", "secret", "AKIAAKIA" + "Z" * 14]
    for _ in range(400):
        t = "".join(rng.choice(parts) for _ in range(12))
        want = sorted([(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])
        base, spans = secrets.secret_spans(t, secrets.trained())
        assert base == want and set(base) <= set(spans)


def test_field_finds_other_makes_and_leaves_plain_text():
    f = secrets.trained()
    found = lambda t: [t[s:e] for s, _, e in secrets.crf_spans(t, f)]
    assert found("deploy with ghp_Ab3dE5fG7hI9jK1lM2nO3pQ4rS5tU6vW7xY8 now") == ["ghp_Ab3dE5fG7hI9jK1lM2nO3pQ4rS5tU6vW7xY8"]
    for t in ("mail me at that.92@mail2.example.com or (499) 555-6503", "see 192.168.10.25 and version-1.20.3 on 2024-10-11", "ids 7536784127813050 4845168114407329 end"):
        assert found(t) == []


def test_viterbi_equals_all_paths():
    import itertools

    f, rng = secrets.trained(), np.random.default_rng(1)
    for _ in range(30):
        s = rng.normal(size=(5, 3)) * 3
        score = lambda p: f.move[secrets.O, p[0]] + sum(s[i, t] for i, t in enumerate(p)) + sum(f.move[a, b] for a, b in zip(p, p[1:]))
        assert f.viterbi(s) == list(max(itertools.product(range(3), repeat=5), key=score))


def test_cut_equals_all_labellings():
    import itertools

    rng = random.Random(6)
    for _ in range(60):
        n = rng.randrange(1, 8)
        src, snk = [rng.randrange(9) for _ in range(n)], [rng.randrange(9) for _ in range(n)]
        e = [(i, j, rng.randrange(5)) for i in range(n) for j in range(i)]
        cost = lambda x: sum(snk[i] if x[i] else src[i] for i in range(n)) + sum(c for a, b, c in e if x[a] != x[b])
        assert cost(html_extract.minimum_cut(src, snk, e)) == min(map(cost, itertools.product([False, True], repeat=n)))


def test_main_text():
    page = """<html><head><title>T</title></head><body><header class="site-header"><h1>Site</h1></header><div id="cookie-notice">We use cookies</div><main><article><header><h1>Title &amp; more</h1></header><p>First   para<br>goes <a href=x>on</a>.
    <p>Second &lt;b&gt; para.<div class="advert"><p>Buy now this great thing it is really the best thing you could buy</div><ul><li>one<li>two</ul><form><input><label>Name</label></form><script>var a="</p>";</script></article>
    <section class="comments"><p>I think that this article is wonderful and I read it all.</section></main><footer>&copy; x</footer>"""
    assert html_extract.main_text(page) == "Title & more\nFirst para goes on.\nSecond <b> para.\none\ntwo"


def test_language_held_out_accuracy(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    r = language.identify_all(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(r) > 30 and sum(x.lang == x.lang_pred for x in r) >= 0.95 * len(r)


def test_quality_against_plain_counts(spark):
    from veilframe.llm import quality_rules

    d = spark.read.parquet(f"{SF}/documents.parquet")
    lexicon, rules = quality_rules.learn(d, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    got = {r.doc_id: r for r in quality_rules.judge(d, lexicon, rules).collect()}
    for r in d.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text)
        times = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {j for i in range(len(w) - 2) if times[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in r.text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r.text)), len(lines) - len(set(lines)), len(again))
        assert g.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and not (g.base_failed and g.kept)


def test_rules_learn_a_conjunction():
    from veilframe.llm import quality_rules as q

    rng = random.Random(5)
    rows = [{n: rng.random() for n in q.STATS} | {"order": i} for i in range(600)]
    for r in rows:
        r["bad"] = r["upper_share"] > 0.6 and r["dup_lines"] > 0.5
    rules = q.cover(rows)
    wrong = sum(any(x.holds(r) for x in rules) != r["bad"] for r in rows)
    assert rules and wrong <= 0.05 * len(rows)


def test_chat_equals_sql(spark):
    rows = [(1, 0, "u", "Hello there\nfriend\n\nsecond para"), (1, 1, "a", "> hello  there\n> friend\nAnswer one"), (1, 2, "u", "> > Hello there friend\n> answer one\n\nThanks"), (1, 3, "u", "> second para\nlate"), (2, 0, "u", "> second para\n>not known\nmine"), (3, 0, "a", "solo"), (3, 1, "b", "  > solo \n>\n> solo\n x > y ")]
    got = chat_quotes.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(map(tuple, got), key=str) == sorted(con.execute(chat_quotes.ORACLE).fetchall(), key=str)
