"""The ten operators and the pipeline against brute force and defined cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from nearfield.llm import bpe, decontaminate, html_text, langid, lm_score, near_dedup, pii, quality, registry, sharding, url_filter

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, fp string, words string, g string, id string"


@pytest.fixture(scope="module")
def texts():
    """Null, empty, blank, repeated, near and very long texts, some with repeated doc_ids."""
    rng = random.Random(5)
    pool = ["".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    plain = [" ".join(rng.choice(pool) for _ in range(rng.randint(60, 200))) for _ in range(40)]
    near = plain[0].replace(plain[0].split()[10], "changed", 1)
    rows = [(k, t) for k, t in enumerate(plain)]
    rows += [(100, None), (101, ""), (102, " \t\n"), (103, plain[0]), (103, plain[0]), (104, plain[0]), (105, near), (106, "x"), (107, "ÉCOLE Überall 日本語 ΑΣ"), (108, plain[1] + "\n" + plain[1]), (109, " ".join(pool * 60)), (None, plain[3]), (110, "a b c a b c a b c " * 20)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if (i or 0) % 3 else None, "s", len(t or ""), "r", "f", "w", "g", "i") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# ---------------------------------------------------------------- 1
def test_urls_rules_and_parts(spark):
    urls = [None, "", "nothing", "http://A.Example.NET/en/1?x#y", "http://example.net/de/", "https://x.example.com/de/9", "ftp://b.org/fr/a", "http://net/", "http://xnet/", "http://c.net", "http://c.net?q=/", "http://www.casino-win.example.org/en/1", "http://www.city-museum.example.org/en/1"]
    df = spark.createDataFrame([(k, u, "clash", "clash") for k, u in enumerate(urls)] + [(3, urls[3], "c", "c")], "page_id long, url string, host string, features string")
    got = url_filter.judge(df, url_filter.train(spark)).collect()
    assert len(got) == len(urls) + 1
    by = {r["page_id"]: r for r in got}
    assert [(by[k]["host"], by[k]["path"]) for k in range(4)] == [("", ""), ("", ""), ("", ""), ("a.example.net", "/en/1")]
    assert [by[k]["rule"] for k in range(3, 11)] == ["example.net/en/", "net/", "example.com/de/", "org/fr/", "net/", None, None, None]
    assert [by[k]["verdict"] for k in (0, 3, 4, 5, 6, 7, 11, 12)] == ["allow", "allow", "block", "block", "allow", "block", "block", "allow"]
    assert url_filter.judge(df.limit(0), url_filter.train(spark)).count() == 0


# ---------------------------------------------------------------- 2
def test_pii_surrogates(spark, empty):
    rows = [
        (1, "Mail that.92@mail2.example.com or THAT.92@MAIL2.EXAMPLE.COM, +1 (743) 555-3824, +1-743-555-3824."),
        (2, "70.23.22.57 and 999.2.3.4; card 4111 1111 1111 1111, 4111111111111111, not 1234567890123456"),
        (3, None), (4, ""), (5, "plain words only"),
        (6, 'Mrs. Anna Schmidt met Mr Smith and господин Иванов. token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'),
        (7, "again that.92@mail2.example.com"), (7, "again that.92@mail2.example.com"),
    ]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, row string, n_entities string")
    out = pii.replace(df, "key").select("row.doc_id", "row.text", "n_entities").collect()
    got = {r["doc_id"]: r["text"] for r in out}
    assert len(out) == len(rows) and got[3] is None and got[4] == "" and got[5] == rows[4][1]
    for secret in ("that.92@", "555-3824", "70.23.22.57", "4111 1111", "4111111111111111", "Schmidt", "Smith", "Иванов", "24be64"):
        assert not any(secret in (t or "") for t in got.values())
    assert "999.2.3.4" in got[2] and "1234567890123456" in got[2]
    mail = re.search(r"again (\S+)", got[7])[1]
    assert mail in got[1] and mail.upper() in got[1]  # one entity, whatever its format
    a, b = re.findall(r"\+1[ -]\(?(\d{3})\)?[ -](\d{3})-(\d{4})", got[1])
    assert a == b
    card = re.search(r"card ([\d ]+), (\d+)", got[2])
    assert card[1].replace(" ", "") == card[2]
    digits = [int(c) for c in reversed(card[2])]
    assert sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(digits)) % 10 == 0
    given = re.search(r"Mrs\. ([\w-]+) \w+ met Mr \w+ and господин [А-Яа-я]+", got[6])[1]  # later attempts join names by hyphens
    assert set(given.split("-")) <= set(pii.GIVEN["FL"])
    assert pii.replace(df, "other").select("row.text").collect() != [(r["text"],) for r in out]
    assert pii.replace(empty, "key").count() == 0


def test_pii_collisions_keep_entities_apart(spark, monkeypatch):
    def few(digest):  # only 30 addresses, so that 25 entities collide
        return F.concat(F.lit("10.0.0."), (pii._nth(digest, F.lit(0), 30) + 1).cast("string"))

    monkeypatch.setattr(pii, "_address", few)
    df = spark.createDataFrame([(k, f"host 50.1.1.{k}") for k in range(25)], "doc_id long, text string")
    got = [r[0] for r in pii.replace(df, "key").select("row.text").collect()]
    assert len(set(got)) == 25


# ---------------------------------------------------------------- 3
def test_html_main_text(spark):
    tree = html_text.grow(*html_text.labelled_rows())
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site <a href="/">x</a></header><nav><a href="/a">Menu</a></nav><div class="ad">Buy now</div>
    <article><h1>Title &amp; more</h1><p><b>First<br><p>Second   line&nbsp;here</p><p>No.</p></article><aside>More</aside><div class="comments"><p>I liked this story very much indeed, thanks.</p></div><footer>&copy; x</footer></body>"""
    assert html_text.main_text(page, tree) == "Title & more\nFirst\nSecond line here\nNo."
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p>unclosed text that goes on for a while <!-- and then a comment"), (5, "u", "a < b and <"), (1, "u", page), (6, "u", "<article><p>" + "long word " * 50000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = html_text.extract(df).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    by = {r["page_id"]: r["text"] for r in got}
    assert by[2] == by[3] == "" and by[4].startswith("unclosed text") and len(by[6]) > 400000
    assert html_text.extract(df.limit(0)).count() == 0


def test_html_whole_pages(spark, sf_dir):
    import html

    tree = html_text.grow(*html_text.labelled_rows())
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        want = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert html_text.main_text(r["html"], tree) == "\n".join(w for w in want if w)


# ---------------------------------------------------------------- 4
def test_lm_counts_and_direction(spark, docs, empty, texts):
    labels = spark.createDataFrame([(k, 1, 0) for k in range(0, 20)] + [(0, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    flagged = lm_score.with_target(docs, labels)
    assert flagged.count() == len(texts)
    sums = lm_score.counts(flagged).toPandas()
    words = sums[sums.entry >= 1 << lm_score.PAIR_BITS]
    assert words.background.sum() == sum(len((t or "").lower().encode().split()) for _, t in texts)
    want = Counter()
    for _, t in texts:
        want.update(lm_score.word_ids(t).tolist())
    assert dict(zip(words.entry - (1 << lm_score.PAIR_BITS), words.background)) == want
    out = lm_score.score(flagged, lm_score.models(lm_score.counts(flagged))).toPandas()
    assert len(out) == len(texts) and np.isfinite(out.score).all()
    assert (out[out.n_words == 0].score == 0).all()
    assert lm_score.score(lm_score.with_target(empty, labels), lm_score.models(lm_score.counts(lm_score.with_target(empty, labels)))).count() == 0


def test_lm_prefers_the_target(spark):
    rng = random.Random(2)
    a, b = [f"alpha{k}" for k in range(30)], [f"beta{k}" for k in range(30)]
    rows = [(k, " ".join(rng.choice(a if k % 2 else b) for _ in range(80))) for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(1, 60, 2)], "doc_id long, quality int")
    flagged = lm_score.with_target(df, labels)
    out = lm_score.score(flagged, lm_score.models(lm_score.counts(flagged))).toPandas()
    assert out[out.doc_id % 2 == 1].score.max() < out[out.doc_id % 2 == 0].score.min()


def test_lm_counts_and_losses_are_exact(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "CHUNK_BYTES", 20_000)
    rows = [(k, " ".join(f"w{(k * 997 + j * j * 31 + j) % 150_000}" for j in range(600))) for k in range(500)] + [(None, "w1 w2 w1"), (None, "w1 w2 w1"), (900, " "), (901, "ab" + "x" * 62 + "c"), (902, "cb" + "x" * 62 + "a")]
    labels = spark.createDataFrame([(k, 1) for k in range(0, 500, 3)], "doc_id long, quality int")
    flagged = lm_score.with_target(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    words, pairs = (Counter(), Counter()), (Counter(), Counter())
    for i, t in rows:
        w = t.split()
        for m in (0, 1) if i is not None and i < 500 and i % 3 == 0 else (1,):
            words[m].update(w)
            pairs[m].update(zip(w, w[1:]))
    fitted = lm_score.models(lm_score.counts(flagged))
    sums = fitted.table.toPandas()
    assert fitted.n_chunks > 20 and len(sums) == len(words[1]) + len(pairs[1])
    assert Counter(sums.background) == Counter(words[1].values()) + Counter(pairs[1].values())
    totals = [w.total() for w in words]
    scale = totals[0] / totals[1]

    def loss(w, m, share):
        own, both, k, out = Counter(w), Counter(zip(w, w[1:])), scale if m else 1.0, []
        seen = lambda x: max(words[m][x] * k - own[x] * share, 0.0)
        for j, x in enumerate(w):
            p = (seen(x) + lm_score.PRIOR) / (totals[m] * k - len(w) * share + lm_score.PRIOR * len(words[1]))
            if j:
                c = max(pairs[m][w[j - 1], x] * k - both[w[j - 1], x] * share, 0.0)
                before = max(seen(w[j - 1]), c)
                p = lm_score.PAIR_WEIGHT * c / before + (1 - lm_score.PAIR_WEIGHT) * p if before > 1e-9 else p
            out.append(-np.log(p))
        return sum(out) / max(1, len(w))

    want = sorted((-1 if i is None else i, loss(t.split(), 0, float(i is not None and i < 500 and i % 3 == 0)), loss(t.split(), 1, scale)) for i, t in rows)
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["target_loss"], r["background_loss"]) for r in lm_score.score(flagged, fitted).collect())
    assert np.allclose(got, want, rtol=1e-6)


def test_lm_sends_no_row_an_entry(spark, monkeypatch):
    """op4_lm's failed check: a row an entry and chunk, there and back, took more disk than four times the input."""
    monkeypatch.setattr(lm_score, "CHUNK_BYTES", 200_000)
    rows = [(k, " ".join(f"w{(k * 997 + j * j * 31 + j) % 150_000}" for j in range(600))) for k in range(400)]
    flagged = lm_score.with_target(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    scores = []
    for size in (1 << 24, 70_000):  # one range of pairs, and many
        monkeypatch.setattr(lm_score, "RANGE_BYTES", size)
        fitted = lm_score.models(lm_score.counts(flagged))
        entries = len(fitted.table.toPandas())
        sent = fitted.table.answers.agg(F.count("*").alias("n"), F.sum(F.octet_length("target") + F.octet_length("background")).alias("bytes")).first()
        assert sent["n"] < 0.01 * entries and sent["bytes"] < 3 * entries
        scores.append(sorted(map(tuple, lm_score.score(flagged, fitted).collect())))
    assert scores[0] == scores[1] and len(scores[0]) == len(rows)
    values = np.array([0, 255, 256, (1 << 63) - 1])
    assert all((lm_score._unpacked(lm_score._packed(v, z)) == v).all() for v in (values, values[:2], values[:0]) for z in (True, False))


# ---------------------------------------------------------------- 5
def test_bpe_like_the_library(spark, docs, texts, sf_dir):
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary()
    tok, codec = Tokenizer.from_file(path), bpe.Codec(bpe.load_vocabulary(path))
    rng = random.Random(1)
    alpha = "abcXYZ 019 ,.!?'sΣİKéÉé \u0085\x1c\x1f\n\t​日本語🙂ßſ½²Ⅷ_`<|endoftext|> 'll"
    samples = [t for _, t in texts if t] + ["".join(rng.choice(alpha) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    samples += ["<|endoftext|>Hi <|startoftext|><|endoftext|> x", "a" * 5000, "qzxk" * 500, "é" * 300 + "qq"]
    for s in samples:
        ids, said = codec.encode(s)
        want = tok.encode(s, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want and said == tok.decode(want, skip_special_tokens=False) == codec.decode(want)
    got = bpe.encode_documents(docs, path, keep_ids=True).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["ids_sha256"] == hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest() and r["n_tokens"] == len(r["ids"])
    assert {r["n_tokens"] for r in got if r["doc_id"] in (100, 101, 102)} == {0}


def test_bpe_forgets_and_gives_the_same(monkeypatch):
    path = bpe.default_vocabulary()
    whole = bpe.Codec(bpe.load_vocabulary(path))
    monkeypatch.setattr(bpe, "REMEMBER", 3)
    short = bpe.Codec(bpe.load_vocabulary(path))
    text = "one two three four five six seven eight, nine; ten! " * 20
    assert whole.encode(text) == short.encode(text) and len(short.words) <= 3


# ---------------------------------------------------------------- 6
def test_language_identification(spark, docs, empty, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.train(*langid.training_sample(table))
    out = langid.predict(table, model).join(table.select("doc_id", "lang"), "doc_id").withColumn("held", langid.fold("doc_id") == 2).toPandas()
    assert (out[out.held].lang_pred == out[out.held].lang).mean() > 0.9
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert [got[k]["lang_pred"] for k in (100, 101, 102)] == ["und"] * 3
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.predict(empty, None).count() == 0 and langid.train([], [], []) is None


# ---------------------------------------------------------------- 7
def test_winnowing_like_brute_force(spark, docs, texts, empty):
    long = [t for _, t in texts if t and len(t.split()) > 60]
    items = [(1, " ".join(long[2].split()[5:40])), (2, " ".join(long[4].split()[:10])), (3, "X"), (4, "a, B! c"), (5, None), (6, "..."), (7, " ".join(long[2].split()[5:14]) + " other"), (8, items_tail(long[6]))]
    bench = spark.createDataFrame([(*i, "clash") for i in items], "item_id long, text string, words string")
    pat = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows, lengths = defaultdict(set), set()
    for i, t in items:
        w = pat.findall((t or "").translate(UP))
        n = min(10, len(w))
        if n:
            lengths.add(n)
            for k in range(len(w) - n + 1):
                windows[tuple(w[k : k + n])].add(i)
    got = decontaminate.contamination(docs, bench).collect()
    assert len(got) == len(texts)
    want = Counter()
    for i, t in texts:
        w = pat.findall((t or "").translate(UP))
        hit, found = set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if s := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= s
        want[i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)] += 1
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got) == want
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(n for k, n in want.items() if not k[-1])
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def items_tail(text):
    return " ".join(text.split()[-12:])


def test_winnowing_by_shuffle(spark, docs, monkeypatch):
    long = docs.where("doc_id = 2").first()["text"]
    bench = spark.createDataFrame([(1, " ".join(long.split()[3:30]))], "item_id long, text string")
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256"]
    key = lambda df: sorted(map(str, df.select(*cols).collect()))
    small = key(decontaminate.contamination(docs, bench))
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert key(decontaminate.contamination(docs, bench)) == small


# ---------------------------------------------------------------- 8
def _fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def test_trie_links_like_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 1500, dtype=np.uint64) * np.uint64(2)
    flips = base[:400].copy()
    for _ in range(4):
        flips ^= np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)
    dense = np.uint64(12345) ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))
    x = np.unique(np.concatenate([base, flips, base[:200] ^ np.uint64(31), dense, np.array([0, 1], np.uint64)]))
    got = {(int(i), int(j)) for a, b in near_dedup.trie_links(x, x, True, 4) for i, j in zip(a, b)}
    i, j = np.where(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= 4, 1))
    assert got == set(zip(i.tolist(), j.tolist()))
    y = np.unique(base[:300] ^ np.uint64(7))
    cross = {(int(p), int(q)) for a, b in near_dedup.trie_links(x, y, False, 4) for p, q in zip(a, b)}
    i, j = np.where(np.bitwise_count(x[:, None] ^ y[None, :]) <= 4)
    assert cross == set(zip(i.tolist(), j.tolist()))


@pytest.mark.parametrize("target", [None, 4])
def test_components_like_brute_force(spark, docs, texts, empty, monkeypatch, target):
    if target:  # many upper nodes, so that links cross them
        monkeypatch.setattr(near_dedup, "upper_nodes", lambda c, t, f=near_dedup.upper_nodes: f(c, target))
    known = [(i, t) for i, t in texts if i is not None]
    got = near_dedup.link_documents(docs.where("doc_id is not null")).collect()
    fps = {i: _fingerprint(t) for i, t in known}
    parent = {i: i for i in fps}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if (fps[a] ^ fps[b]).bit_count() <= 4 and find(a) != find(b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    assert Counter((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in got) == Counter((i, fps[i], find(i)) for i, _ in known)
    kept = near_dedup.keep_one(docs.where("doc_id is not null"))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == {find(i) for i in ids}
    assert near_dedup.link_documents(empty).count() == 0


def test_components_of_chains(spark):
    edges = [(k + 1, k) for k in range(40)] + [(100, 7), (100, 60), (61, 60)]
    got = {r["node"]: r["root"] for r in near_dedup.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in [*range(1, 41), 60, 61, 100]}


# ---------------------------------------------------------------- 9
def _counts(text):
    w = _words(text)
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    seen, cover = Counter(grams), set()
    for k, g in enumerate(grams):
        if seen[g] > 1:
            cover |= {k, k + 1, k + 2}
    lines = [x for x in (text or "").split("\n") if _words(x)]
    failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover), failed


def test_quality_counts(docs, texts, empty):
    got = quality.judge(docs).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert Counter((r["doc_id"], *(r[c] for c in names)) for r in got) == Counter((i, *_counts(t)) for i, t in texts)
    assert not any(r["kept"] for r in got if r["base_failed"])
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)
    assert quality.judge(empty).count() == 0 and quality.keep_good(empty).count() == 0


def test_quality_outliers(spark):
    rng = random.Random(3)
    pool = ["".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    rows = [(k, " ".join(rng.choice(pool) for _ in range(rng.randint(60, 300)))) for k in range(200)]
    rows += [(1000 + k, " ".join(w + "$$$" for w in t.split())) for k, (_, t) in enumerate(rows[:20])]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["kept"] for r in quality.judge(df).collect()}
    assert all(got[k] for k in range(200)) and not any(got[1000 + k] for k in range(20))


def test_quality_judges_small_groups(spark):
    rng = random.Random(4)
    pool = ["".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    text = lambda: " ".join(rng.choice(pool) for _ in range(rng.randint(60, 300)))
    odd = lambda: " ".join(w + "$$$" for w in text().split())
    rows = [(k, text(), "en", "large") for k in range(120)]
    rows += [(200 + k, odd() if k < 2 else text(), "en", "small") for k in range(12)]
    rows += [(300 + k, odd() if k < 2 else text(), "xx", "rare") for k in range(9)] + [(400, odd(), None, None), (401, "too short", "yy", "none")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality.judge(df).collect()}
    assert len(got) == len(rows) and all(r["distance2"] is not None for k, r in got.items() if k != 401)
    assert {k for k, r in got.items() if not r["kept"]} == {200, 201, 300, 301, 400, 401}


# ---------------------------------------------------------------- 10
def test_sharding(spark, docs, texts, empty, tmp_path):
    records = sharding.sized(docs)
    loads = sharding.slot_loads(records)
    first = sharding.first_map(loads, 4)
    got = sharding.assign(records, first, loads).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts)
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    path = str(tmp_path / "map")
    sharding.write_map(first, path)
    again = sharding.rebalance(sharding.read_map(spark, path), loads, 5)
    sharding.write_map(again, path)
    latest = sharding.read_map(spark, path)
    assert {r["version"] for r in latest.collect()} == {1} and {r["shard"] for r in latest.collect()} <= set(range(5))
    assert sharding.read_map(spark, path, 0).count() == first.count() == latest.count()
    nothing = sharding.sized(empty)
    assert sharding.assign(nothing, sharding.first_map(sharding.slot_loads(nothing), 4), sharding.slot_loads(nothing)).count() == 0


def test_sharding_is_even_and_moves_little(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "repeat('x', cast(id % 97 as int)) as text")
    records = sharding.sized(df)
    loads = sharding.slot_loads(records).cache()
    first = sharding.first_map(loads, 10).cache()
    sizes = [r["b"] for r in loads.join(first, "vslot").groupBy("shard").agg(F.sum("bytes").alias("b")).collect()]
    assert max(sizes) - min(sizes) <= 97 + 16
    moved = first.alias("a").join(sharding.rebalance(first, loads, 10).alias("b"), "vslot").where("a.shard <> b.shard").count()
    assert moved == 0


# ---------------------------------------------------------------- pipeline
def test_pipeline_stage_by_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination", "pii_surrogates", "bpe_encoding"]
    want = docs
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        want = stage(spark, want, sf_dir)
        assert want.columns == docs.columns
        want = want.cache()
        sizes.append(want.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[3] == sizes[4] > 0
    assert not want.where(F.col("text").rlike(r"@mail[0-9]\.example\.com")).count()
    out = corpus_pipeline.run(spark, sf_dir)
    assert sorted(r["doc_id"] for r in out.select("doc_id").collect()) == sorted(r["doc_id"] for r in want.select("doc_id").collect())


def test_registry_names():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
