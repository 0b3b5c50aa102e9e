"""Each training-data operator against a plain version, and on nulls, ties, repeats, empty tables and clashing columns."""

import base64
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from factloom.llm import bpe, chat, components, dac, decontaminate, html_text, quality, registry, shared, simhash, topk, toxicity, warc

DOC = "doc_id long, text string, ids string, bits long, n_words string, score double"
LONG = " ".join(f"word{i}" for i in range(3000))
#: Nulls in every column, empty and long texts, repeated rows, columns that clash with what operators add.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog again and again today", None, 1, "x", 0.5),
    (1, "The quick brown fox jumps over the lazy dog again and again today", None, 1, "x", 0.5),
    (2, None, "a", None, None, None),
    (3, "", "", 3, "", 0.1),
    (4, LONG, "z", 4, "y", 0.2),
    (5, LONG.upper(), None, 5, "y", None),
    (6, "Ünïcode ÉCOLE <|endoftext|>  two\n\n spaces 　 and 123's", None, None, None, None),
    (None, "a row without an id", None, None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOC)


@pytest.fixture(scope="module")
def none(spark, docs):
    return spark.createDataFrame([], docs.schema)


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(registry.tokenizer_path())


def test_bpe(spark, docs, none):
    lib = library()
    got = bpe.encode(docs, registry.tokenizer_path(), decoded=True).collect()
    assert len(got) == len(ROWS)
    by_id = {r.doc_id: r for r in got}
    for doc_id, text, *_ in ROWS:
        ids = lib.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(by_id[doc_id].ids, "<u4").tolist() == ids and by_id[doc_id].n_tokens == len(ids)
        assert by_id[doc_id].decoded == lib.decode(ids, skip_special_tokens=False)
    assert bpe.encode(none, registry.tokenizer_path()).count() == 0
    broken = spark.createDataFrame([(1, bytearray(np.array([163, 5, 99999], "<u4").tobytes())), (2, None)], "doc_id long, ids binary")
    got = {r.doc_id: r.decoded for r in bpe.decode(broken, registry.tokenizer_path()).collect()}
    assert got == {1: lib.decode([163, 5], skip_special_tokens=False), 2: ""}


def test_bpe_random_texts_and_memory():
    import random

    lib, random_ = library(), random.Random(5)
    with open(registry.tokenizer_path(), "rb") as f:
        source = f.read()
    coder, other = bpe.ByteBpe(source, remembered=20_000), bpe.LibraryBpe(source, remembered=20_000)
    letters = " \n\t\r 　\x1c\x85ab'sllé1²!?.<|😀́|"
    texts = ["".join(random_.choice(letters) for _ in range(random_.randint(1, 40))) for _ in range(3000)]
    for text, expected in zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == expected.ids
        assert coder.encode(text) == other.encode(text)
    together = pa.array([*texts, None, "", "<|endof", "text|>"], pa.string())
    for one in (coder, other):
        ids, at = one.encode_all(together)
        assert [ids[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)] == [coder.encode(t) for t in together.to_pylist()]
        assert one.decode_all(ids, at).to_pylist() == [t or "" for t in together.to_pylist()]
        assert 160 * (len(one.young) + len(one.old)) <= 20_400


def test_bpe_every_kind_of_character():
    """Each code point between letters, digits, marks and blanks, against the library."""
    lib = library()
    with open(registry.tokenizer_path(), "rb") as f:
        coder = bpe.LibraryBpe(f.read())
    points = [c for c in [*range(0x600), *range(0x600, 0x30000, 37), 0x2028, 0x3000, 0xFEFF, 0x10FFFF] if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}b {c} 1{c}.{c}'s '{c}\n{c}  {c}" for c in map(chr, points)]
    ids, at = coder.encode_all(pa.array(texts))
    for i, expected in enumerate(lib.encode_batch(texts, add_special_tokens=False)):
        assert ids[at[i] : at[i + 1]].tolist() == expected.ids, hex(points[i])


def test_bpe_long_words_and_endings():
    lib = library()
    with open(registry.tokenizer_path(), "rb") as f:
        coder = bpe.ByteBpe(f.read())
    for text in ("x" * 70_000 + "  " + "%" * 5_000, "we'll they've I'd 're'vex it'sn't 'S ''s 'l 'r '", " 's\n's's'", "<|endoftext|>'s <|endoftext|> <|endoftext|<|endoftext|>"):
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids


def test_dac_levels():
    rng = np.random.default_rng(2)
    for ids in (np.zeros(0, np.uint32), np.array([0, 255, 256, 2**32 - 1], np.uint32), rng.integers(0, 50_257, 5000).astype(np.uint32), np.zeros(700, np.uint32)):
        levels = dac.split_levels(ids)
        assert dac.join_levels(levels).tolist() == ids.tolist()
        assert [dac.pick(levels, i) for i in range(0, len(ids), 7)] == ids[::7].tolist()


def test_token_files(spark, docs, none):
    lib = library()
    folder = shared.shared_dir(spark, "tokens")
    manifest = dac.write(docs, folder, registry.tokenizer_path(), files=3, slice_bytes=500)
    got = dac.checksums(dac.read(spark, manifest)).orderBy("start").collect()
    expected, start = [], 0
    hashed = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    for doc_id, text, *_ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, hashed[r[1]])):
        ids = np.array([*lib.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        expected.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == expected
    file = dac.TokenFile(manifest[-1][0])
    whole = np.concatenate([ids for _, ids in file.documents()])
    assert [file[i] for i in range(0, len(file), 97)] == whole[::97].tolist()
    file.close()
    assert dac.files_for(docs) == 1 and dac.files_for(none) == 1
    assert dac.read(spark, dac.write(none, shared.shared_dir(spark, "tokens"), registry.tokenizer_path())).count() == 0


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(names, values, near):
    root = {n: n for n in names}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, a in enumerate(names):
        for b in names[:i]:
            if near(values[a], values[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in names}


def test_simhash(spark, docs, none):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    texts = {r[0]: r[1] for r in ROWS}
    ids = sorted(i for i in texts if i is not None)
    prints = {i: plain_fingerprint(texts[i]) for i in texts}
    roots = plain_components(ids, prints, lambda a, b: (a ^ b).bit_count() <= 4)
    for r in got:
        assert r.fingerprint == f"{prints[r.doc_id]:016x}"
        assert r.doc_id is None or r.component_id == roots[r.doc_id]
    assert roots[5] == 4 and roots[3] == 2
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("block", [4096, 5])
def test_covering_misses_no_link(spark, block):
    import random

    random_ = random.Random(3)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    found = set()
    for _ in range(15):
        base = random_.getrandbits(64)
        for _ in range(12):
            made = base
            for bit in random_.sample(range(64), random_.randint(0, 7)):
                made ^= 1 << bit
            found.add(made)
    nodes = spark.createDataFrame([(signed(v),) for v in found], "bits long")
    got = {r.node: r.component for r in components.components(simhash.links(nodes, 4, block)).collect()}
    names = sorted(map(signed, found))
    roots = plain_components(names, {n: n & (1 << 64) - 1 for n in names}, lambda a, b: (a ^ b).bit_count() <= 4)
    assert {n: got.get(n, n) for n in names} == roots


def test_golay_code_covers():
    covering = simhash.Covering(0, 23)
    words = np.arange(0, 1 << 23, 97, dtype=np.uint32)
    assert np.bitwise_count(words ^ covering.nearest(words)).max() == 3
    assert len(np.unique(covering.nearest(np.arange(1 << 18, dtype=np.uint32)))) <= 4096


def plain_hits(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    doc, hit, named = words(text), set(), set()
    for item_id, item in items:
        w = words(item)
        n = min(13, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(doc) - n + 1 if n else 0):
            if tuple(doc[i : i + n]) in windows:
                hit.update(range(i, i + n))
                named.add(str(item_id))
    return len(doc), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(doc)


def test_decontaminate(spark, docs, none):
    items = [
        (10, "word5 word6 word7 word8 word9 word10 word11 word12 word13 word14 word15 word16 word17 word18 word19 unlike"),
        (11, "fox jumps over"), (12, "dog"), (13, "ÉCOLE"), (14, None), (15, "..."), (16, "the QUICK, brown fox jumps"), (9, "again and again"), (9, "again and again"),
        (17, "word100 word101 word102 word103 word104 word105 word106 word107 word108 word109 word110 word111 other"),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.verdicts(decontaminate.decontaminate(docs, bench)).collect()
    assert len(got) == len(ROWS)
    texts = {r[0]: r[1] for r in ROWS}
    for r in got:
        assert tuple(r)[1:] == plain_hits(texts[r.doc_id], items), r
    assert not decontaminate.verdicts(decontaminate.decontaminate(docs, spark.createDataFrame([], bench.schema))).where("n_hit > 0").count()
    assert decontaminate.decontaminate(none, bench).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, ([0.5] * 8 if i % 7 == 0 else (rng.normal(size=8) * np.exp(rng.normal() * 1.2)).tolist())) for i in range(800)]
    rows += [(2000, None), (2001, [1.0, None] + [0.0] * 6), (2002, [float("nan")] * 8), (2003, [1.0, 2.0]), (2100, [float("inf")] * 8), (None, [1.0] * 8), (2200, [0.0] * 8), (2300, [1.0, 2.0]), (2400, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"score": F.lit(1), "rank": F.lit(2)})
    rows += [(300, [3.0] * 8), (777, [4.0] * 8), (777, [4.0] * 8), (3000, [1e300] * 8), (3100, [2.0**21] * 8)]
    df = df.unionByName(spark.createDataFrame(rows[-5:], "vec_id long, embedding array<double>").withColumns({"score": F.lit(1), "rank": F.lit(2)}))
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 100 == 0, bucket=60, block=3).collect())
    kept = [(i, [int(np.floor(1024 * x)) for x in v], n) for n, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and abs(x) < 2**21 for x in v)]
    expected = []
    for i, q, n in (x for x in kept if x[0] % 100 == 0):
        best = sorted((-sum(a * b for a, b in zip(q, p, strict=True)), j) for j, p, m in kept if m != n and len(p) == len(q))[:10]
        expected += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert got == sorted(expected)
    assert topk.top_k(spark.createDataFrame([], df.schema), F.col("vec_id") % 100 == 0).count() == 0


@pytest.mark.parametrize("size", [8 << 20, 97])
def test_warc(spark, size):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.1\r\nx"
    rows = [(i, f"http://x/\n{i}" if i % 3 else None, fake * (i % 5) if i % 2 else None if i % 10 == 0 else f"é{i % 40}") for i in range(120)] + [(None, "u", "zz"), (-5, "u", "minus"), (7, None, fake * 2), (7, None, fake * 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("id", F.lit(1)).withColumn("block", F.lit("x"))
    folder = shared.shared_dir(spark, "warc")
    warc.write(df.repartition(2), folder)
    got = sorted((tuple(r) for r in warc.pages(warc.read(spark, folder, size)).collect()), key=repr)
    best = {}
    for i, _, h in rows:
        if i is not None:
            best[h or ""] = max(best.get(h or "", i), i)
    expected = []
    for i, _, h in rows:
        data, first = (h or "").encode(), best.get(h or "", i)
        expected.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first == i else "revisit", None if first == i else first))
    assert got == sorted(expected, key=repr)


def test_warc_empty_and_broken(spark):
    folder = shared.shared_dir(spark, "warc")
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.read(spark, folder).count() == 0
    folder = shared.shared_dir(spark, "warc")
    spark.createDataFrame([("WARC/1.1\r\nContent-Length: 50\r\n\r\nshort",)], "x string").coalesce(1).write.text(folder)
    with pytest.raises(Exception, match="breaks off"):
        warc.read(spark, folder).collect()


PAGE = """<html><head><title>T</title><style>x{}</style></head><body class="has-sidebar"><header><h1>Site</h1><p>Slogan of the site here.</p></header>
<nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies on this site, please accept them all now.</div>
<div id="content"><h1>Title of it</h1><p>A long first paragraph of the article &amp; more words here, quite a few.</p><div class=ad>Buy now, the best offer in the town today!</div><p>Second &nbsp; para<b>graph</b> with <a href=y>a link</a> inside it.</p><ul><li>Short item<li>Another one</ul>
<form><label>Mail</label><input><button>Send</button></form></div><aside><p>Related stories that are long enough to look like text.</p></aside><script>var t="</p>";</script>
<section id="comments"><article class="comment"><p>I think this article is great, thanks a lot for it.</p></article></section><footer>(c) me</footer>"""


def test_html(spark):
    text = "Title of it\nA long first paragraph of the article & more words here, quite a few.\nSecond paragraph with a link inside it.\nShort item\nAnother one"
    df = spark.createDataFrame([(1, PAGE), (1, PAGE), (2, None), (3, ""), (4, "plain text only &lt; here"), (5, "<p>a < b <<p>c"), (6, "<p>one<br>two<br/> three")], "page_id long, html string").withColumn("text", F.lit("clash"))
    for model in (None, html_text.fit(df), html_text.fit(df.limit(0))):
        got = [(r.page_id, r.text) for r in html_text.with_text(df, model=model).collect()]
        assert got == [(1, text), (1, text), (2, ""), (3, ""), (4, "plain text only < here"), (5, "a < b <\nc"), (6, "one two three")]
    assert html_text.with_text(df.limit(0)).count() == 0


def test_min_cut_is_minimal():
    import itertools
    import random

    random_ = random.Random(4)
    for _ in range(150):
        n = random_.randint(1, 6)
        score = [random_.uniform(-3, 3) for _ in range(n)]
        edges = [(i, j, random_.uniform(0, 2)) for i in range(n) for j in range(i) if random_.random() < 0.6]
        cost = lambda keep: sum(abs(s) for s, k in zip(score, keep, strict=True) if (s > 0) != k) + sum(w for a, b, w in edges if keep[a] != keep[b])  # noqa: B023, E731
        assert cost(html_text.min_cut(score, edges)) == pytest.approx(min(cost(k) for k in itertools.product([True, False], repeat=n)))


def test_chat(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "ho"), (1, 2, "user", None), (1, 3, None, "yes"), (0, 0, "user", "x"), (0, 1, "assistant", "no"), (0, 1, "assistant", "no"), (None, None, "user", "lost"), (9, 0, "user", "alone")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    got = {r.pair_id: r for r in chat.preferences(chat.swapped_pairs(chat.conversations(df))).collect()}
    b, e = chat.BEGIN, chat.END
    assert set(got) == {0, 1, 9, None}
    assert got[1].n_prompt_turns == 3 and got[1].prompt == f"{b}user\nhi{e}\n{b}assistant\nho{e}\n{b}user\n{e}\n"
    assert got[1].chosen == f"{b}unknown\nyes{e}\n" and got[1].rejected == f"{b}unknown\nno{e}\n" and got[1].chosen_trained == []
    assert got[0].chosen == f"{b}assistant\nno{e}\n" and [got[0].chosen[s.begin : s.end] for s in got[0].chosen_trained] == ["no" + e]
    lost = spark.createDataFrame([(None, i, "user", f"lost {i % 3}") for i in range(6)], df.drop("turns").schema)
    assert sorted(len(r.turns) for r in chat.conversations(lost).collect()) == [1] * 6
    assert got[9].rejected == "" and got[9].chosen == f"{b}user\nalone{e}\n"
    pairs = spark.createDataFrame([(1, None, None)], f"pair_id long, chosen array<{chat.TURN}>, rejected array<{chat.TURN}>")
    assert tuple(chat.preferences(pairs).first())[1:4] == (0, "", "")


def _labelled(n=600):
    rng, docs, labels = np.random.default_rng(3), [], []
    for i in range(n):
        words = ["".join(rng.choice(list("etaoinshr"), int(rng.integers(2, 8)))) for _ in range(int(rng.integers(30, 90)))]
        bad, toxic = i % 6 == 0, i % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(int(rng.integers(0, len(words))), ["wretchmug", "grubkins"][int(rng.integers(0, 2))] + ["", "s", "er"][int(rng.integers(0, 3))])
        docs.append((i, " ".join(w + "%%%" if bad else w for w in words)))
        if i % 4:
            labels.append((i, 0 if bad else 1, int(toxic)))
    return docs, labels


def test_classifiers(spark, docs, none):
    rows, labels = _labelled()
    table, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit(table, known)
    assert 0.7 < model.prior < 0.95
    texts = [t for _, t in rows]
    q, t = model.scores(texts), toxicity.fit(table, known).scores(texts)
    assert ((q >= quality.THRESHOLD) == np.array([i % 6 != 0 for i, _ in rows])).mean() > 0.97
    right = (t >= toxicity.THRESHOLD) == np.array([i % 5 == 0 for i, _ in rows])
    assert right.mean() > 0.95 and right[[zlib.crc32(str(i).encode()) % 5 == 0 for i, _ in rows]].mean() > 0.9
    scored = quality.with_score(docs, model, name="score").collect()
    assert len(scored) == len(ROWS) and all(0 <= r.score <= 1 for r in scored)
    empty = quality.fit(none, known)
    assert quality.with_score(none, empty).count() == 0 and empty.scores(["a", None]).tolist() == [0.5, 0.5]
    nothing = toxicity.fit(table, known.where("toxic = 0"))
    assert nothing.scores(["a", None, ""]).tolist() == [0, 0, 0]
    assert toxicity.fit(table, known).scores([None, "", " \n"]).tolist() == [0, 0, 0]
