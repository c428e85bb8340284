"""The corpus operators against brute force, exact round trips, held-out accuracy and odd rows, on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import common, decontam, html, langid, lines, minhash, mixing, quality, tokens, urls, warc
from lodestone.llm.queries import QUERIES
from lodestone.storage import materialize

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = ["alpha", "beta", "gamma", "delta", "of", "the", "and", "x1", "Über", "naïve", "end."]


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def texts(seed=0, n=60):
    """Texts with copies, near copies, repeated lines, odd white space, long and empty ones, nulls."""
    r = random.Random(seed)
    word = lambda: r.choice(VOCABULARY) + str(r.randrange(40))
    out = [" ".join(word() for _ in range(r.randrange(1, 120))) for _ in range(n)]
    for i in range(0, n, 3):
        words = out[i].split(" ")
        words[r.randrange(len(words))] = "changed"
        out += [out[i], " ".join(words), out[i].upper()]
    shared = "A line that several documents share\n\tPadded  shared line \n"
    out += [shared + out[k] for k in range(5)] + [shared.upper() + "short\nshort\n", "", None, " \t\n", "one", "two words", "x " * 30_000, "a\x0bb\x0cc\rd", "ends\n", "\n\n"]
    return out


def documents(spark, seed=0, n=60):
    rows = [(i * 3, t, ("en", "de", None)[i % 3], (None, "s2", "s1", "é", "s10")[min(i % 7, 4)], len(t or "")) for i, t in enumerate(texts(seed, n))]
    return spark.createDataFrame(rows, SCHEMA)


def odd(spark, docs):
    """The same rows with a repeated row, a null doc_id and columns whose names clash with the operators' own."""
    more = docs.unionByName(docs.where("doc_id = 3")).unionByName(docs.where("doc_id = 6").withColumn("doc_id", F.lit(None).cast("long")))
    return more.withColumns({c: F.lit(1) for c in ("kept", "size", "rep", "band", "part", "key", "_k", "row_id", "start", "score", "lang_pred", "text_hash", "h", "node")})


def sets(docs, k):
    out = {}
    for r in docs:
        w = WORD.findall(low(r.text))
        out[r.doc_id] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


def brute_components(docs, k, percent=80):
    found = sets(docs, k)
    parent = {d: d for d in found}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(found)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(found[a] & found[b])
            if both and 100 * both >= percent * (len(found[a]) + len(found[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(found[d]), root(d)) for d in ids}


# -- shared helpers -------------------------------------------------------------------------------------------------


def test_words_are_those_of_the_pattern():
    data = pa.array([t if t is not None else None for t in texts()][3:] + ["é a b", "  x"], pa.string())
    raw, offsets = common.text_bytes(data)
    starts, ends, at = common.word_spans(raw, offsets)
    for i, t in enumerate(data.to_pylist()):
        assert [bytes(raw[s:e]).decode() for s, e in zip(starts[at[i] : at[i + 1]], ends[at[i] : at[i + 1]])] == WORD.findall(t or "")


# -- 1 --------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("k", [2, 5])
def test_minhash_matches_brute_force(spark, k):
    docs = documents(spark)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, k).collect()}
    want = brute_components(docs.collect(), k)
    assert got == want and any(d != c for d, (_, c) in want.items())


def test_minhash_recall_at_the_threshold(spark):
    """Chains and stars of pairs near similarity 0.8 in one large group, where one hub per bucket is not enough."""
    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randrange(0, 9)):
            w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.near_duplicates(docs, 2).collect()}
    assert got == brute_components(docs.collect(), 2)


def test_minhash_odd_rows(spark):
    got = minhash.near_duplicates(odd(spark, documents(spark)), 2).collect()
    assert len(got) == documents(spark).count() + 2
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert minhash.near_duplicates(documents(spark).limit(0), 2).count() == 0
    kept = minhash.keep_one(documents(spark), 2)
    assert {r.doc_id for r in kept.collect()} == {d for d, (_, c) in brute_components(documents(spark).collect(), 2).items() if d == c}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90)], "a long, b long")
    assert {(r.node, r.component) for r in minhash.components(edges).collect()} == {(i, 0) for i in range(1, 41)} | {(100, 90)}


# -- 2 --------------------------------------------------------------------------------------------------------------


def test_pfor_blocks():
    rng = np.random.default_rng(1)
    for ids in (np.array([7]), np.zeros(1024), np.array([0, 2**32 - 1]), rng.integers(0, 50_000, 1024), rng.integers(0, 90, 500) ** 4, np.r_[rng.integers(0, 9, 1000), 40_000]):
        ids = ids.astype(np.uint32)
        block = tokens.pack_block(ids)
        assert (tokens.unpack_block(memoryview(block), 0) == ids).all()
    assert len(block) < 700  # an outlier goes to the exceptions


def test_tokens_match_the_library(spark):
    from tokenizers import Tokenizer

    docs = documents(spark).unionByName(spark.createDataFrame([(9001, "don't STOP <|endoftext|> x|y, é́ ß ｆｕｌｌ 　 12.5% 'll", "en", "s", 1), (9002, "<|STARTOFTEXT|> I'M a.b.c É", "en", "s", 1)], SCHEMA))
    plain = Tokenizer.from_file(tokens.default_tokenizer())
    start = 0
    got = {r.doc_id: r for r in tokens.token_table(docs, tokens.default_tokenizer()).collect()}
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 1]
        x = got[r.doc_id]
        assert (x.start, x.n_tokens, x.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_encoders_know_what_splits_words():
    import public_tokenizers

    assert tokens.WordEncoder(tokens.default_tokenizer()).by_word and not tokens.WordEncoder(public_tokenizers.path("byte_bpe_50k.json")).by_word
    split = {"type": "Split", "pattern": {"Regex": "[\\p{L}]+|[^\\s\\p{L}]+"}, "behavior": "Removed", "invert": True}
    assert tokens.splits_words({"normalizer": None, "pre_tokenizer": split}) and tokens.splits_words({"pre_tokenizer": {"type": "WhitespaceSplit"}})
    assert not tokens.splits_words({"pre_tokenizer": split | {"pattern": {"Regex": "[\\p{L}]+|\\s+"}}}) and not tokens.splits_words({"pre_tokenizer": None})
    assert not tokens.splits_words({"normalizer": {"type": "Prepend", "prepend": "_"}, "pre_tokenizer": split})


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoders_give_the_library_s_ids(file):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(file)
    plain, rows = Tokenizer.from_file(path), [*texts(3, 30), "don't STOP <|endoftext|> x|y,  é́ ß 　 12.5% 'll", "tab\tand\n\nlines"]
    got = list(tokens.WordEncoder(path)(pa.array(rows, pa.string())))
    assert [g.tolist() for g in got] == [plain.encode(t or "", add_special_tokens=False).ids for t in rows]


def test_shards_are_read_in_runs():
    import io

    rng, stream = np.random.default_rng(0), io.BytesIO()
    writer = tokens.ShardWriter(stream)
    docs = [rng.integers(0, 50_000, int(n)).astype(np.uint32) for n in rng.integers(0, 5000, 300)] + [np.zeros(0, np.uint32)]
    for i, d in enumerate(docs):
        writer.add(i if i else None, d)
    writer.close()
    raw, most = stream.getvalue(), []

    def read(n, at):
        most.append(n)
        return raw[at : at + n]

    shard = tokens.Shard(read, len(raw))
    got = [x for _, ids in shard.documents(20_000) for x in ids]
    assert len(got) == len(docs) and all((a == b).all() for a, b in zip(got, docs)) and shard.null[0] == 1
    assert max(most) < len(raw) / 10


def test_tokens_odd_rows(spark):
    _, manifest = tokens.write_shards(odd(spark, documents(spark)), tokens.default_tokenizer())
    rows = tokens.read_shards(manifest, with_ids=True).orderBy("start").collect()
    assert rows[0].doc_id is None and rows[0].start == 0 and all(r.ids[-1] == 1 for r in rows)
    assert sum(r.doc_id == 3 for r in rows) == 2
    assert all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:]))
    assert tokens.token_table(documents(spark).limit(0), tokens.default_tokenizer()).count() == 0


# -- 3 --------------------------------------------------------------------------------------------------------------

RULED = [
    ("https://shop.com/x", "shop.com", "/x", "com/", "allow"), ("http://WWW.Example.com/en/1?q=1", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("http://a.www.example.com/en/", "a.www.example.com", "/en/", "www.example.com/en/", "allow"), ("http://example.com/en/2#t", "example.com", "/en/2", "example.com/en/", "block"),
    ("http://m.example.com/en/2", "m.example.com", "/en/2", "example.com/en/", "block"), ("http://notexample.com/en/2", "notexample.com", "/en/2", "com/", "allow"), ("http://x.net/es/1", "x.net", "/es/1", "net/es/", "block"),
    ("http://x.com", "x.com", "", None, None), ("no scheme", "", "", None, None), (None, "", "", None, None), ("http://x.org?a=/b", "x.org", "", None, None), ("http://x.net/en/1", "x.net", "/en/1", None, None), ("", "", "", None, None),
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, r[0], "") for i, r in enumerate(RULED)] + [(None, "http://q.org/", "")], "page_id long, url string, html string")
    got = {r.page_id: r for r in urls.judged(pages.withColumn("rule", F.lit("x")).withColumn("suffix", F.lit("y"))).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(RULED):
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block")
        assert verdict is None or r.verdict == verdict
    assert urls.judged(pages.limit(0)).count() == 0


def test_trees_judge_unlisted_sites(spark):
    """Labels of whole hosts held out: what they teach carries over to new hosts and to new suffixes, with no one verdict."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    _, x, y, hosts, share = urls.labelled_urls(pages)
    known, new = urls.held_out_auc(x, y, hosts, share)
    assert known > 0.95 and new > 0.75
    judged = urls.judged(pages).where("rule is null").agg(F.avg((F.col("verdict") == "block").cast("int"))).first()[0]
    assert 0.1 < judged < 0.9


def test_suffix_statistics_leave_the_own_host_out(spark):
    sites = [("http://a.x.com/en/1", "allow"), ("http://a.x.com/en/2", "allow"), ("http://b.x.com/en/1", "block"), ("http://c.y.org/fr/1.html", None)]
    pages = spark.createDataFrame([(i, u, "") for i, (u, _) in enumerate(sites)] + [(9, None, ""), (8, "http://" + "z" * 100_000, "")], "page_id long, url string, html string")
    rows, x, y, hosts, share = urls.labelled_urls(pages.unionByName(pages.limit(1)), (("a.x.com/", "allow"), ("b.x.com/", "block")))
    assert share == 1 / 4 and sorted(zip(hosts, y)) == [("a.x.com", 0.0)] * 3 + [("b.x.com", 1.0)]
    at = {h: x[i] for i, h in enumerate(hosts)}
    blocked, n = urls.FEATURES.index("host1_blocked"), urls.FEATURES.index("host1_labelled")
    assert np.isclose(at["a.x.com"][blocked], (1 + urls.WEIGHT * share) / (1 + urls.WEIGHT)) and np.isclose(at["a.x.com"][n], np.log1p(1))
    assert np.isclose(at["b.x.com"][blocked], urls.WEIGHT * share / (3 + urls.WEIGHT)) and np.isclose(at["b.x.com"][urls.FEATURES.index("host3_blocked")], share)
    assert rows.count() == 7 and urls.auc(np.array([0.1, 0.5, 0.5, 0.9]), np.array([0.0, 0.0, 1.0, 1.0])) == 0.875


def test_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, len(urls.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    model = urls.fit_trees(x[:2000], y[:2000])
    assert ((urls.tree_scores(model, x[2000:]) > 0.5) == y[2000:]).mean() > 0.95


# -- 4 --------------------------------------------------------------------------------------------------------------


def test_targets_reshare_the_excess():
    got = mixing.targets([100, 1000, 10], [5, 2, 1], 1.5, 2)
    assert got[0] == 200 and got[2] == 20 and abs(sum(got) - 1665) < 1e-9
    assert mixing.targets([], [], 1.5, 2) == [] and mixing.targets([0, 0], [5, 2], 1.5, 2) == [0, 0]


def test_permutation_is_one():
    for n in (1, 2, 3, 64, 1000, 4097):
        assert sorted(mixing.permute(np.arange(n), n, 12345)) == list(range(n))
        assert list(mixing.unpermute(mixing.permute(np.arange(n), n, 12345), n, 12345)) == list(range(n))
    assert list(mixing.permute(np.arange(100), 100, 1)) != list(mixing.permute(np.arange(100), 100, 2))


def test_slots_hold_just_the_target():
    """All sizes and targets of small sources: the slots' words add up, wherever the short block comes."""
    for size in range(1, 40):
        per = -(-size // 8)
        for target in range(0, 2 * size + 1):
            n, last = mixing.slots_of(size, target, 8, lambda turn: 31 * size + turn)
            words = []
            for j in range(n):
                b = int(mixing.permute(np.array([j % per]), per, 31 * size + j // per)[0])
                words.append(8 if b < per - 1 else size % 8 or 8)
            assert not n or 0 < last <= words[-1]
            assert sum(words[:-1]) + last == target


def test_mix_reaches_its_targets(spark):
    docs = odd(spark, documents(spark))
    rows = mixing.taken_words(docs).collect()
    assert len(rows) == docs.count() and sorted(map(str, rows)) == sorted(map(str, mixing.taken_words(docs).collect()))
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    sizes = {}
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(WORD.findall(r.text or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, mixing.targets([sizes[n] for n in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5, 2)))
    assert {(r.source_size, r.target) for r in rows} == {(sizes[n], want[n]) for n in names}
    by_target = Counter()
    for r in rows:
        by_target[(r.source_size, r.target)] += r.taken
    assert all(abs(t - n) <= 1 for (_, t), n in by_target.items())
    assert mixing.taken_words(docs.limit(0)).count() == 0


def test_mixed_rows_keep_their_own_columns(spark):
    """Rows that share doc_id and text but not their source are taken apart; equal rows each take their own words."""
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(1, text, "en", "a", 1), (1, text, "de", "b", 1), (1, text, "de", "b", 1), (None, text, "fr", None, 1), (2, None, "en", "a", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    mixed = mixing.mixed_documents(docs)
    words = Counter()
    for r in mixed.collect():
        words[r.source, r.lang] += len(WORD.findall(r.text))
    want = dict(zip(("a", "b", None), mixing.targets([300, 600, 300], [5, 2, 1], 1.5, 2)))
    assert {k: v for (k, _), v in words.items()} == {k: round(v) for k, v in want.items()} and set(words) == {("a", "en"), ("b", "de"), (None, "fr")}
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mixing.mixed_documents(docs.repartition(3)).collect()))


def test_shard_counts_share_out_all_slots():
    slots = np.array([1000, 0, 7, 50_000])
    parts = [mixing.shard_counts(slots, 9, k, 3) for k in range(9)]
    assert (sum(n for _, n in parts) == slots).all() and max(n.sum() for _, n in parts) - min(n.sum() for _, n in parts) <= 1
    for s in range(4):
        runs = sorted((int(first[s]), int(n[s])) for first, n in parts if n[s])
        assert all(a + n == b for (a, n), (b, _) in zip(runs, runs[1:])) and (not runs or runs[0][0] == 0)


def test_mixed_documents_hold_the_taken_words(spark):
    docs = documents(spark)
    taken = {r.doc_id: r.taken for r in mixing.taken_words(docs).collect()}
    mixed = mixing.mixed_documents(odd(spark, docs).where("doc_id <> 3 and doc_id is not null")).select("doc_id", "text", "n_chars", "rep")
    assert mixed.where("n_chars <> length(text)").count() == 0
    mixed = mixing.mixed_documents(docs).collect()
    words = Counter()
    for r in mixed:
        words[r.doc_id] += len(WORD.findall(r.text))
    assert {d: n for d, n in taken.items() if n} == dict(words)
    original = {r.doc_id: Counter(WORD.findall(r.text or "")) for r in docs.collect()}
    assert all(Counter(WORD.findall(r.text)) <= original[r.doc_id] for r in mixed)


# -- 5 --------------------------------------------------------------------------------------------------------------


def brute_lines(rows):
    key = lambda x: low(x.strip(" \t\n\x0b\x0c\r"))
    order = lambda d: (d is None, d)
    holders = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                holders.setdefault(key(x), set()).add(d)
    out = []
    for d, t in rows:
        ls = (t or "").split("\n")
        keep = [x for x in ls if len(key(x)) < 10 or min(holders[key(x)], key=order) == d]
        out.append((d, len(ls), len(ls) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("clash", [False, True])
def test_line_dedup_matches_brute_force(spark, clash):
    docs = documents(spark, 2, 40)
    docs = odd(spark, docs) if clash else docs
    got = lines.kept_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_lines([(r.doc_id, r.text) for r in docs.collect()]), key=str)
    assert sum(r.n_dropped for r in got) > 0
    assert lines.kept_lines(docs.limit(0)).count() == 0


def test_a_line_of_every_document_spans_partitions(spark):
    rows = [(i, f"own line number {i}\nThe very common line\n" + "the very common line  \n" * (i % 3)) for i in range(3000, 0, -1)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = lines.kept_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sorted(map(tuple, got)) == sorted(brute_lines(rows))


def test_keep_bitmaps(spark):
    maps = lines.dropped_lines(spark.createDataFrame([(1, "a shared line\nx"), (2, "x\nA SHARED line \nlast")], "doc_id long, text string")).collect()
    assert [(m.doc_id, lines.keep_bits(m.bitmap, 3).tolist()) for m in maps] == [(2, [True, False, True])]
    assert lines.keep_bits(None, 2).tolist() == [True, True]


# -- 6 --------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li>Home</li></ul></nav>
<div class="cookie-notice">We use cookies</div><!-- no --><main><article id="post-with-sidebar"><header><h1>A &amp; B</h1></header><p>First <b>bold</b>
 text&nbsp;here.<p>Second<script>var x = "</p>";</script> one.</p><div class="ad">Buy</div><aside>Side</aside><ul><li>item 1<li>item 2</ul>
<form><input>Name</form><div class="share-links">Share</div></article><section id="comments"><article class="comment"><p>Nice!</p></article></section></main>
<footer>&copy; X</footer></body></html>"""


def test_main_text_of_a_marked_page(spark):
    want = "A & B\nFirst bold text here.\nSecond one.\nitem 1\nitem 2"
    assert "\n".join(t for t, mark, z, _ in html.blocks(PAGE) if mark < html.OUT_MARK and z == html.ARTICLE) == want
    pages = spark.createDataFrame([(1, "http://a/x", PAGE), (2, None, None), (3, "http://a/y", ""), (1, "http://a/x", PAGE), (None, "u", "<p>only"), (5, "http://b/z", "no markup &lt;here")], "page_id long, url string, html string").withColumns({c: F.lit(0) for c in ("host", "path", "key", "lines", "rank")})
    got = sorted([(r.page_id is None, r.page_id, r.text) for r in html.main_texts(pages).collect()], key=str)
    assert got == sorted([(False, 1, want), (False, 1, want), (False, 2, ""), (False, 3, ""), (True, None, "only"), (False, 5, "no markup <here")], key=str)
    assert html.main_texts(pages.limit(0)).count() == 0


def test_differencing_removes_what_neighbours_share(spark):
    page = lambda i: f"<body><div>Our site</div><div>Menu one</div><p>Own text of page {i} is here</p><p>and another {i * 7}</p><div>All rights reserved</div></body>"
    rows = [(i, f"http://h/a/{i}", page(i)) for i in range(6)] + [(10, "http://lone/a", page(10)), (11, "http://copy/1", page(11)), (12, "http://copy/2", page(11))]
    got = {r.page_id: r.text for r in html.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Own text of page {i} is here\nand another {i * 7}" for i in range(6))
    assert got[10].startswith("Our site") and got[11] == got[12] and "Own text of page 11" in got[11]


def test_words_of_a_class_delete_article_text_only_if_shared(spark):
    names = ("legal-analysis", "notice-of-appeal", "market-share", "search-results")
    body = "".join(f'<div class="{n}">About {n}</div>' for n in names)
    page = lambda i, more="": f'<article><h1>Title {i}</h1>{body if not i else ""}<p>Text {i} <p title="a>hello {i}{more}<div class="ad-box2 left">Buy</div><div id="comments"><p>Nice</div></article>'
    promoted = '<div class="related-reading">More of our site</div><ul><li><a href="/x">Our links</a></ul>'
    rows = [(i, f"http://h/a/{i}", page(i, promoted if i > 1 else "")) for i in range(6)]
    got = {r.page_id: r.text for r in html.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == "\n".join(["Title 0", *(f"About {n}" for n in names), "Text 0", "hello 0"])
    assert all(got[i] == f"Title {i}\nText {i}\nhello {i}" for i in range(1, 6))


def test_templates_longer_than_the_text_and_windows(spark):
    """Stub pages on a heavy template, copies beside them, one host over several windows, very long and repeated pages."""
    head = "".join(f"<p>A long line of the site's own template, number {i}</p>" for i in range(40))
    rows = [(i, f"http://h/s/{i:04d}", f"<body>{head}<p>Stub {i // 2 * 2}</p></body>") for i in range(700)]
    rows += [(9000, "http://h/s/long", "<body>" + head + "".join(f"<p>own {i}</p>" for i in range(20_000)) + "</body>"), rows[0], (9001, "http://other/", head)]
    got = {r.page_id: r.text for r in html.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert got[9000] == "\n".join(f"own {i}" for i in range(20_000)) and got[9001].count("\n") == 39
    assert len(got) == 702 and html.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).count() == 703


def test_longest_common_subsequence(monkeypatch):
    def length(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    r = random.Random(3)
    for _ in range(200):
        a, b = ([r.randrange(6) for _ in range(r.randrange(12))] for _ in range(2))
        for most in (0, 1 << 16):
            monkeypatch.setattr(html, "MATCHES", most - 8 * 24 * (not most))
            found = sorted(html.common(a, b))
            it = iter(b)
            assert len(found) == length(a, b) and all(any(a[i] == y for y in it) for i in found)
    a, b = [1] + [5] * 20_000 + [2] + [5] * 20_000, [3] + [5] * 30_000 + [2, 4]
    assert len(html.common(a, b)) == 30_000


# -- 7 --------------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    trap = "x" * 50 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n" + "y" * 1200
    big = "é" * 600
    rows = [(1, "http://a/1", trap), (2, "http://a/2\n%", big), (3, None, big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", trap), (8, "u", "WARC/1.1\r\n" * 300), (None, "u", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(0) for c in ("digest", "n", "target", "path", "start")})
    _, files = warc.write_archives(pages.repartition(2))
    for size in (warc.RANGE_BYTES, 700, 64):
        got = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(files, size).collect()}
        want = set()
        for i, _, text in rows:
            raw = (text or "").encode()
            same = [j for j, _, t in rows if (t or "") == (text or "") and j is not None]
            again = len(raw) >= 1000 and same and i != max(same)
            want.add((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", max(same) if again else None))
        assert got == want
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_long_headers(spark):
    rows = [(1, "http://a/1", "one"), (2, "http://a/" + "u" * 1_000_000, "two"), (3, "http://a/" + "\n" * 50_000, "three WARC/1.1\r\nx: " + "z" * 70_000), (4, "http://a/4", "four")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    _, files = warc.write_archives(pages.coalesce(1))
    for size in (warc.RANGE_BYTES, 40_000):
        got = sorted((r.page_id, r.url, r.payload_bytes) for r in warc.read_archives(files, size).collect())
        assert got == [(i, u.replace("\n", "%0A"), len(t)) for i, u, t in rows]


def test_warc_payload_of_headers(spark):
    """A payload full of well-formed headers of large lengths: only what is kept is hashed, and in pieces."""
    inner = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 100000\r\n\r\n" * 3000 + "x" * 100_000
    rows = [(1, "u", inner), (2, "u", "between"), (3, "u", inner + "y"), (4, "u", None)]
    _, files = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1))
    for size in (warc.RANGE_BYTES, 50_000):
        got = sorted((r.page_id, r.payload_bytes, r.payload_digest) for r in warc.read_archives(files, size).collect())
        assert got == [(i, len(t or ""), hashlib.sha1((t or "").encode()).hexdigest()) for i, _, t in rows]


def test_warc_broken_archives_fail(spark):
    _, files = warc.write_archives(spark.createDataFrame([(i, "u", "text") for i in range(5)], "page_id long, url string, html string").coalesce(1))
    path = files.first().path.removeprefix("file:")
    whole = Path(path).read_bytes()
    for broken in (whole[:-10], b"x" + whole, whole + b"more"):
        Path(path).write_bytes(broken)
        with pytest.raises(Exception, match="before the file's end"):
            warc.read_archives(files.withColumn("bytes", F.lit(len(broken)).cast("long"))).collect()


def test_pointer_jumping():
    starts, ends = np.array([0, 10, 15, 30, 40]), np.array([10, 30, 40, 40, 50])
    assert warc.reachable(starts, ends).tolist() == [True, True, False, True, True]
    assert warc.reachable(np.array([5]), np.array([9])).tolist() == [False]
    n = 1000
    assert warc.reachable(np.arange(n) * 7, np.arange(1, n + 1) * 7).all() and len(warc.reachable(np.zeros(0, int), np.zeros(0, int))) == 0


# -- 8 --------------------------------------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = QUERIES["op8_language"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98


def test_language_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(150)
    more = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "123 !? 4", "de", "s", 0), (9003, "", None, "s", 0), (None, "the and of the", None, None, None)], SCHEMA)
    got = {r.doc_id: r for r in langid.identify(docs.unionByName(more).withColumn("h", F.lit(1)), langid.train(docs.unionByName(more))).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (9001, 9002, 9003)) and got[None].lang_pred != "und"
    assert langid.train(docs.where("lang is null")).langs == []
    assert {r.lang_pred for r in langid.identify(docs.limit(3), langid.train(docs.limit(0))).collect()} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0
    one = docs.withColumn("lang", F.lit("xx"))
    assert {r.lang_pred for r in langid.identify(one).collect()} == {"xx"}
    assert langid.known_language(docs.unionByName(more)).columns == docs.columns
    clash = docs.withColumns({"score": F.lit("x"), "lang_pred": F.lit(1)})
    again = langid.identify(clash.unionByName(clash), langid.train(docs)).select("doc_id", "text", "lang_pred", "score").collect()
    assert len(set(again)) * 2 == len(again) and all(isinstance(r.score, float) for r in again)
    long = spark.createDataFrame([(1, "the and of it was " * 200_000, None, None, 1)], SCHEMA)
    assert langid.identify(long, langid.train(docs)).first().lang_pred == "en"
    assert langid.known_language(docs.unionByName(more), least_score=1.1).count() == 0
    labels_ = [(i, f"text number {i}", f"l{min(i // 50, i % 40):02d}", "s", 1) for i in range(150)] + [(i, "rare", f"x{i}", "s", 1) for i in range(200, 240)]
    assert langid.train(spark.createDataFrame(labels_, SCHEMA), languages=3).langs == ["l00", "l01", "l02"]


# -- 9 --------------------------------------------------------------------------------------------------------------


def brute_leaks(docs, items):
    """Counted Jaccard of five-word shingles of every item-sized window."""
    def words(t):
        return re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if ord(c) < 0xDF else c for c in t or ""))

    shingles = lambda w: Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    out = {}
    for d, t in docs:
        w = words(t)
        for i, u in items:
            v = words(u)
            if not v or not w:
                continue
            n, s = min(len(v), len(w)), shingles(v)
            for k in range(len(w) - n + 1):
                x = shingles(w[k : k + n])
                both = sum((x & s).values())
                if both and both / (sum(x.values()) + sum(s.values()) - both) >= 0.8:
                    out.setdefault(d, set()).add(i)
    return out


def test_decontamination_matches_brute_force(spark):
    r = random.Random(9)
    item = lambda n: " ".join(f"w{r.randrange(300)}" for _ in range(n))
    items = [(i, item(n)) for i, n in enumerate((40, 25, 40, 6, 5, 3, 60))] + [(7, None), (8, ""), (9, "É Two Über three four five six seven")]
    items.append((10, items[0][1]))
    filler = lambda: " ".join(f"f{r.randrange(5000)}" for _ in range(r.randrange(0, 200)))
    docs = [(0, None), (1, ""), (2, filler())]
    for i, t in items:
        if t:
            w = t.split()
            docs += [(len(docs), f"{filler()} {t} {filler()}"), (len(docs) + 1, f"{filler()}\n{t.upper().replace(' ', ', ')}!"), (len(docs) + 2, " ".join(["x", *w[1:], "y"])), (len(docs) + 3, " ".join(w[: len(w) // 2])), (len(docs) + 4, t), (len(docs) + 5, " ".join(w[:-1])), (len(docs) + 6, " ".join([*w[:8], "z", *w[8:]]))]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = decontam.contaminated(frame, bench).collect()
    assert {x.doc_id: set(x.item_ids) for x in rows if x.contaminated} == brute_leaks(docs, items) and len(rows) == len(docs)
    before = decontam.PART_ITEMS
    decontam.PART_ITEMS = 3
    try:
        assert sorted(map(str, decontam.contaminated(frame, bench).collect())) == sorted(map(str, rows))
    finally:
        decontam.PART_ITEMS = before
    assert decontam.clean(odd(spark, documents(spark)), bench).columns == odd(spark, documents(spark)).columns
    assert decontam.contaminated(frame.limit(0), bench).count() == 0
    assert decontam.contaminated(frame, bench.limit(0)).where("contaminated").count() == 0


def test_decontamination_finds_windows_at_the_threshold(spark):
    r = random.Random(5)
    word = lambda: f"w{r.randrange(10**9)}"
    items = [(i, " ".join(word() for _ in range(100))) for i in range(400)]
    docs = [(i, " ".join([*t.split()[:90], *(word() for _ in range(10))])) for i, t in items]
    rows = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {x.doc_id: list(x.item_ids) for x in rows if x.contaminated} == {i: [i] for i, _ in items}


@pytest.mark.parametrize("n", [1, 40, 20_000])
def test_block_lists_find_all_within_the_radius(n):
    """Short lists are compared, long ones probed; either finds just what a scan finds."""
    rng = np.random.default_rng(n)
    prints = rng.integers(0, 1 << 16, (n, decontam.BLOCKS)).astype(np.uint16)
    bits = np.unpackbits(prints[rng.integers(0, n, 30)].view(np.uint8), axis=1)
    for row in bits:
        row[rng.choice(256, int(rng.integers(0, decontam.RADIUS + 9)), replace=False)] ^= 1
    own = np.packbits(bits, axis=1).view(np.uint16)
    far = np.bitwise_count(own[:, None, :] ^ prints[None, :, :]).sum(axis=2)
    assert sorted(decontam.BlockLists(prints).within(own)) == sorted(zip(*(x.tolist() for x in np.nonzero(far <= decontam.RADIUS))))


def test_fingerprints_in_pieces():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 63, 20_000).astype(np.uint64)
    own = np.unpackbits(common.mix(words[:, None] ^ decontam._SEEDS[None, :]).astype("<u8").view(np.uint8).reshape(-1, 32), axis=1, bitorder="little")
    for n, starts in ((7, np.arange(0, 19_990, 3)), (6000, np.array([0, 5, 13_999])), (3, np.array([4, 19_997])), (20_000, np.array([0]))):
        want = [np.packbits(2 * own[s : s + n].sum(axis=0, dtype=int) > n, bitorder="little").view("<u2") for s in starts]
        assert (decontam.fingerprints(words, starts, n) == np.array(want)).all()


def test_a_document_made_of_many_items_stays_small():
    import tracemalloc

    r = random.Random(1)
    texts_ = [" ".join(f"w{r.randrange(10**6)}" for _ in range(40)) for _ in range(1000)]
    part = decontam.Items(list(range(1000)), texts_)
    peaks = []
    for m in (100, 1000):
        data, offsets = common.text_bytes(pa.array([" ".join(texts_[:m])]))
        words, _ = decontam.words_of(data, offsets)
        flags = {k: part.member(common.shingle_hashes(words, k), k) for k in part.known}
        tracemalloc.start()
        assert len(part.found(words, flags)) == m
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 3 * peaks[0] and peaks[1] < 80e6


# -- 10 -------------------------------------------------------------------------------------------------------------


def test_quality_base_measures(spark):
    docs = odd(spark, documents(spark).unionByName(spark.createDataFrame([(7000, "a b c a b c a b c d e\n#x\n#x\n \n", "en", "s", 1), (7001, "a a a a", "en", "s", 1)], SCHEMA)))
    got = quality.judged(docs).collect()
    want = []
    for r in docs.collect():
        w = WORD.findall(r.text or "")
        windows = {}
        for i in range(len(w) - 2):
            windows.setdefault(tuple(w[i : i + 3]), []).append(i)
        repeated = {p + k for v in windows.values() if len(v) > 1 for p in v for k in range(3)}
        ls = [x for x in (r.text or "").split("\n") if WORD.search(x)]
        want.append((r.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r.text or "")), len(ls) - len(set(ls)), len(repeated), len(w) < 50 or 100 * len(repeated) > 50 * len(w)))
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=str) == sorted(want, key=str)
    assert all(not (r.base_failed and r.kept) for r in got) and quality.judged(docs.limit(0)).count() == 0


def test_em_finds_the_bad_class():
    r = random.Random(4)
    right = {1: 0.97, 0: 0.6}
    rows = []
    for _ in range(4000):
        good = int(r.random() < 0.8)
        rows.append((good, tuple(0 if r.random() < 0.2 else (1 if (r.random() < right[good]) == good else -1) for _ in range(6))))
    prior, model = quality.fit(sorted(Counter(v for _, v in rows).items()))
    assert abs(prior - 0.8) < 0.05
    assert ((quality.posteriors(np.array([v for _, v in rows]), prior, np.array(model)) >= 0.5) == np.array([bool(g) for g, _ in rows])).mean() > 0.95
    assert quality.fit([]) == (quality.PRIOR, [])


def test_quality_follows_the_labels(spark):
    d = "/root/testdata/sf0.1"
    got = QUERIES["op10_quality"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet").withColumnRenamed("quality", "good"), "doc_id").where("not base_failed")
    assert got.where((F.col("good") == 1) != F.col("kept")).count() / got.count() < 0.01


# -- the pipeline ---------------------------------------------------------------------------------------------------


def test_pipeline_stages_follow_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontaminate", "mix_sources", "token_output"]
    known = materialize(corpus_pipeline.language_id(spark, docs, d), "known")
    assert {r.doc_id for r in known.collect()} == {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    unique = materialize(corpus_pipeline.near_dedup(spark, known, d), "unique")
    want = {i for i, (_, c) in brute_components(known.collect(), 5).items() if i == c}
    assert {r.doc_id for r in unique.collect()} == want
    clean = materialize(corpus_pipeline.decontaminate(spark, unique, d), "clean")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    leaks = brute_leaks([(r.doc_id, r.text) for r in unique.collect()], items)
    assert {r.doc_id for r in clean.collect()} == want - set(leaks)
    mixed = materialize(corpus_pipeline.mix_sources(spark, clean, d), "mixed")
    assert mixed.columns == docs.columns
    out = corpus_pipeline.run(spark, d).collect()
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in mixed.collect())
    assert sum(r.n_tokens for r in out) == max(r.start + r.n_tokens for r in out)


def test_pipeline_with_odd_rows(spark, tmp_path):
    """Nulls in every column, repeated rows, a very long text and columns whose names clash, from start to end."""
    folder = str(tmp_path)
    docs = odd(spark, documents(spark, n=20)).unionByName(odd(spark, spark.createDataFrame([(None, None, None, None, None)], SCHEMA)))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "an item"), (None, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    last = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        last = materialize(stage(spark, last, folder), name)
        assert last.columns == docs.columns and last.count() > 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, last, folder).count() == last.count()


def test_pipeline_on_an_empty_table(spark, tmp_path):
    folder = str(tmp_path)
    documents(spark).limit(0).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "an item")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
