"""Near copies, repeated passages, mixing, top-k, page text and the pipeline against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenhand.llm import common, graph, mixing, neardup, repeats, shingles, topk, wrapper
from evenhand.llm.common import documents

WORD = re.compile(r"(?:[A-Za-z0-9_]|[^\x00-\x7f])+")


def brute_classes(rows, threshold=0.8, k=5):
    """class and links of each row number, by all pairs of shingle sets."""
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").lower())
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    root, links = list(range(len(rows))), Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-12:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i in range(len(rows)):
        if rows[i][0] is not None:
            ids[find(i)].append(rows[i][0])
    return [(rows[i][0], min(ids[find(i)], default=None) if sets[i] else rows[i][0], links[i]) for i in range(len(rows))]


@pytest.fixture(scope="module")
def family(spark):
    """Copies, near copies in a chain, a large group of near copies, empty and short texts, repeated rows and null ids."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(120)]
    rows = []
    for i in range(90):
        t = base.copy()
        for _ in range(rng.choice([0, 0, 1, 2, 3, 4])):
            t[rng.randrange(len(t))] = word()
        rows.append((i, " ".join(t)))
    chain = [word() for _ in range(80)]
    for i in range(100, 108):
        chain = chain[4:] + [word() for _ in range(4)]
        rows.append((i, " ".join(chain)))
    rows += [(200, None), (201, None), (202, ""), (203, "!!"), (204, "one two"), (205, "One, two!"), (206, "one two three"), (207, "x" * 5000), (208, "x" * 5000)]
    rows += [(None, rows[0][1]), (None, "only null ids here again and again"), (None, "only null ids here again and again"), (204, "one two"), (204, "one two")]
    rows += [(300 + i, " ".join(word() for _ in range(60))) for i in range(20)]
    return rows, spark.createDataFrame([(*r, "en", 1) for r in rows], "doc_id bigint, text string, Class_ID string, digest int")


def test_near_copies_by_brute_force(family):
    rows, df = family
    for block in (512, 16):
        got = [tuple(r) for r in neardup.classes(df, block=block).collect()]
        assert sorted(map(str, got)) == sorted(map(str, brute_classes(rows)))


def test_one_of_each_class_stays(family):
    rows, df = family
    got = neardup.first_of_each(df)
    assert got.columns == df.columns
    want = Counter((c, f) for (i, _), (_, c, _), f in zip(rows, brute_classes(rows), [0] * len(rows), strict=True) if c is not None)
    ids = Counter(r.doc_id for r in got.collect() if r.doc_id is not None)
    assert set(ids) == {c for c, _ in want} and max(ids.values()) == 1
    assert neardup.classes(df.limit(0)).count() == 0 and neardup.first_of_each(df.limit(0)).count() == 0


def test_near_copies_of_the_given_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in documents(spark, sf).collect()]
    got = [tuple(r) for r in neardup.classes(documents(spark, sf)).collect()]
    assert sorted(got) == sorted(brute_classes(rows))


def test_prefix_is_shortened_to_the_target():
    assert neardup.prefix_length(0.8, 40, 8, 0.99999) == 6
    assert neardup.prefix_length(0.8, 40, 8, 0.5) == 8
    with pytest.raises(ValueError):
        neardup.prefix_length(0.5, 2, 8, 0.99)


def test_overlaps_of_common_and_rare_shingles():
    rng = np.random.default_rng(0)
    sets = [set(rng.choice(60, 30, replace=False).tolist()) for _ in range(40)]
    h = np.array([x for s in sets for x in sorted(s)], np.uint64)
    own = np.repeat(np.arange(40), [len(s) for s in sets])
    for dense in (1, 24, 100):
        got = neardup.overlaps(h, own, 40, dense=dense, columns=7)
        assert all(got[i, j] == len(sets[i] & sets[j]) for i in range(40) for j in range(40) if i != j)


def test_shingles_tell_words_apart():
    texts = ["a b c d e f", "A, b; c d e f!", "ab c d e f", "a b c d f e", None, "a b", "b a"]
    h, n = shingles.shingles(*shingles.word_hashes(texts), 5)
    parts = np.split(h, np.cumsum(n)[:-1])
    assert n.tolist() == [2, 2, 1, 2, 0, 1, 1]
    assert (parts[0] == parts[1]).all() and not set(parts[0]) & (set(parts[2]) | set(parts[3])) and parts[5] != parts[6]


def test_components(spark):
    links = [(5, 3), (3, 9), (9, 12), (1, 2), (2, 2), (20, 21), (21, 22), (22, 23), (23, 24), (24, 25), (40, 30), (50, 30), (60, 30)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {3: 3, 5: 3, 9: 3, 12: 3, 1: 1, 2: 1, **{i: 20 for i in range(20, 26)}, 30: 30, 40: 30, 50: 30, 60: 30}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_joins_on_heavy_keys(spark):
    left = spark.createDataFrame([("h", i) for i in range(60)] + [(f"k{i}", i) for i in range(10)] + [(None, 1), ("none", 2)], "k string, v int")
    right = common.written(spark.createDataFrame([("h", 60, "hot"), *[(f"k{i}", 1, f"r{i}") for i in range(10)]], "k string, n long, what string"), "t")
    got = common.skew_safe_join(left, right, "k", "n", F.concat(F.lit("~"), F.col("v").cast("string")))
    want = left.join(right, "k", "left").select("k", "v", "n", "what")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def brute_runs(rows, least=8):
    seen, out = {}, []
    for i, t in sorted((r for r in rows if r[1]), key=lambda r: r[0]):
        run = None
        for m in repeats.UNIT.finditer(t):
            normal = " ".join(re.split(r"[ \t\r\n]+", m.group().strip(" \t\r\n"))).lower()
            again = bool(normal) and normal in seen
            seen.setdefault(normal, i)
            if again:
                run = (run[0], m.end(), run[2] or len(normal.split(" ")) >= least) if run else (m.start(), m.end(), len(normal.split(" ")) >= least)
            if run and not again:
                out += [(i, run[0], run[1])] if run[2] else []
                run = None
        out += [(i, run[0], run[1])] if run and run[2] else []
    return out


def test_repeats_by_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in documents(spark, sf).collect()]
    assert sorted(map(tuple, repeats.removed(documents(spark, sf)).collect())) == sorted(brute_runs(rows))


def test_repeats_of_odd_rows(spark):
    p = "This passage of many words stands in more than one of these documents. It goes on. And on with a second long sentence of words."
    rows = [(3, f"Mine alone, first of all here and nowhere else at all. {p} Short one. My end.", 0, "x"), (1, f"\n\n{p}\nShort one.", 0, "y"), (7, None, 0, None), (8, "", 0, None), (9, "Short one.", 0, None),
            (4, p + " " + p, 0, None), (5, f"Ünïcode first. {p.upper()}\tShort one.", 0, None), (None, p, 0, None), (None, p, 0, None), (1, f"\n\n{p}\nShort one.", 0, "y"), (10, "word " * 30000 + ".", 0, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint, Spans string")
    got = {(r.doc_id, r.start): r.stop for r in repeats.removed(df).collect()}
    assert {k[0] for k in got} == {3, 4, 5, None} and all(k[0] != 1 for k in got)
    t = dict((r[0], r[1]) for r in rows)
    assert t[3][55 : got[3, 55]].rstrip() == p + " Short one."
    assert got[4, 0] == len(t[4])
    out = repeats.remove_repeats(df)
    assert out.columns == df.columns
    kept = [(r.doc_id, r.text) for r in out.collect()]
    assert sorted(i for i, _ in kept if i is not None) == [1, 1, 3, 5, 7, 8, 9, 10]  # 4 and the rows without id held nothing else
    text = dict(kept)
    assert text[3] == "Mine alone, first of all here and nowhere else at all. My end." and text[5] == "Ünïcode first. " and text[7] is None and text[8] == ""
    assert all(r.n_chars == len(r.text) for r in out.collect() if r.text is not None)
    assert repeats.removed(df.limit(0)).count() == 0


def test_repeated_passages_of_short_units(spark):
    names = [f"{a}{b} is {c}" for a, b, c in zip("abcdefghijklmnopqr", "rqponmlkjihgfedcba", "xyzxyzxyzxyzxyzxyz", strict=True)]
    items, verse = "\n".join(names) + "\n", "!! ".join(f"w{i}" for i in range(60)) + "!! "
    back = "\n".join(names[::-1]) + "\n"
    chinese = "".join(chr(0x4E00 + 7 * i) + ("。" if i % 6 == 5 else "") for i in range(66))
    thai = "".join(chr(0x0E01 + i * i % 40) for i in range(60))
    rows = [(1, f"One begins here.\n{items}One ends."), (2, f"Another text\n{items}goes on."), (3, f"Turned round\n{back}stays."), (4, "A few\n" + "\n".join(names[:11]) + "\nstay."),
            (5, verse), (6, f"Told again: {verse}By me."), (7, f"甲乙。{chinese}丙丁。"), (8, f"戊己。{chinese}庚辛。"), (9, f"x\n{thai}\ny"), (10, f"z\n{thai}\nv"),
            (11, "tail of it\n" + "\n".join(names[2:]) + " and\nmore"), (12, "no. " * 300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    text = dict(rows)
    got = {(r.doc_id, text[r.doc_id][r.start : r.stop].strip()) for r in repeats.removed(df).collect()}
    inner = "\n".join(names[2:-1])
    assert got == {(2, items.strip()), (6, verse.split(" ", 1)[1].strip()), (8, chinese), (10, thai), (11, inner)}


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    t = mixing.targets([10, 1000, 1000], [5, 2, 1])
    assert t[0] == 30 and math.isclose(sum(t), 2010) and math.isclose(t[1], 2 * t[2])
    assert mixing.targets([0, 5], [5, 2]) == [0.0, 5.0] and mixing.targets([], []) == []


def test_quota_tree():
    q = np.array([40, 0, 13, 7])
    for shards in (1, 2, 7, 60):
        parts = mixing.split_quotas(q, shards, np.random.Generator(np.random.PCG64(1)))
        assert parts.shape == (4, shards) and (parts.sum(axis=1) == q).all() and (parts >= 0).all()
        assert parts.sum(axis=0).max() - parts.sum(axis=0).min() <= 1 + 60 // shards


def test_mix(spark, sf):
    rows = [(i, " ".join(["w"] * (1 + i % 17)), f"s{i % 3}", "k") for i in range(900)] + [(i, " ".join(["w"] * (1 + i % 5)), None, "k") for i in range(900, 1000)] + [(2000, None, "s0", "k"), (2001, "", "s9", "k"), (None, "a b c", "s1", "k"), (None, "a b c", "s1", "k")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, Shard string")
    got = mixing.taken(df).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.taken(df.repartition(7)).collect()))
    source = {r[0]: r[2] for r in rows}
    sizes, took, target = Counter(), Counter(), {}
    for r in got:
        s = source[r.doc_id] if r.doc_id is not None else "s1"
        sizes[s] += r.size
        took[s] += r.taken
        target[s] = r.target
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = mixing.targets([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])
    for s, w in zip(names, want, strict=True):
        assert math.isclose(target[s], w) and abs(took[s] - w) <= max(2, 0.01 * w)
    mix = mixing.mixed(df, shards=8)
    assert mix.columns == ["doc_id", "text", "source", "shard", "turn"]
    assert Counter(r.doc_id for r in mix.collect() if r.doc_id is not None) == Counter({r.doc_id: r.taken // r.size for r in got if r.taken and r.doc_id is not None})
    per = Counter(r.shard for r in mix.collect())
    assert len(per) == 8 and max(per.values()) < 3 * min(per.values())
    assert mixing.mix_rows(df).columns == df.columns
    assert mixing.taken(df.limit(0)).count() == 0 and mixing.mix_rows(df.limit(0)).count() == 0


def test_top_k_by_brute_force(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(700, 12)).astype(np.float32)
    v[100:400] = v[100]  # a hot vector: ties
    rows = [(int(i), x.tolist(), 1) for i, x in enumerate(v)] + [(800, None, 1), (820, [1.0, None] * 6, 1), (840, [float("nan")] + [0.0] * 11, 1), (860, [float("inf")] + [0.0] * 11, 1), (None, v[0].tolist(), 1), (20, v[20].tolist(), 1), (701, [], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, Rank int")
    good = [(i, np.floor(64 * np.array(x, float)).astype(int)) for i, x, _ in rows if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)]
    got = defaultdict(list)
    for r in topk.top_k(df, F.col("vec_id") % 20 == 0, block=128, together=16).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    for q, x in good:
        if q % 20 == 0 and q != 20:
            best = sorted(((-int(x @ y) if len(y) else 0, i) for i, y in good if i != q))[:20]
            assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)], q
    few = topk.top_k(df.where("vec_id in (0, 1, 40)"), F.col("vec_id") % 20 == 0)
    assert {(r.query_id, r.rank) for r in few.collect()} == {(0, 1), (0, 2), (40, 1), (40, 2)}
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_tree_matching():
    leaf = lambda x: [x, 1, "", []]
    a, b = ["r", 1, "", [leaf("a"), leaf("b"), leaf("c")]], ["r", 1, "", [leaf("x"), leaf("a"), leaf("c"), leaf("b")]]
    assert wrapper.tree_match(a, b)[0] == 3
    m = wrapper.merge(a, b)
    assert [c[0] for c in m[3]] in (["x", "a", "b", "c", "b"], ["x", "a", "c", "b", "c"])


def test_page_text(spark):
    page = lambda i, body: f'<!DOCTYPE html><html><head><title>t{i}</title><script>var a="</p><p>no";</script></head><body><div id="main-menu"><a href="/{i}">Home {i}</a></div><div class="box">Read this every day, dear reader.</div><div class="cookie-notice">We use {i}</div><div class="text"><h2>Head {i} &amp; more</h2>{body}</div><div class="comments"><p>nice {i}</p></div><footer>f{i}</footer></body></html>'  # noqa: E731, E501
    rows = [(i, f"http://user@A.example:80/{i}", page(i, f"<p>One <b>two</b>\n three{i} &eacute;&#233;<script>x<y</script> four<br>five<p>Next"), 1) for i in range(6)]
    rows += [(10, "https://b.example/x", None, 1), (11, None, "", 1), (12, None, "plain   text", 1), (13, "https://c.example/", "<article><header>no</header><h1>T</h1><p>a<p>b<aside>no</aside><ul><li>x<li>y</ul></article><p>out", 1), (13, "https://c.example/", "<article><header>no</header><h1>T</h1><p>a<p>b<aside>no</aside><ul><li>x<li>y</ul></article><p>out", 1),
             (14, "https://d.example/", "<article><p>cut off he", 1), (15, "https://d.example/", "<main><p>long " + "word " * 20000 + "</main><nav>n</nav>", 1)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, Text int")
    got = {r.page_id: r.text for r in wrapper.main_text(df).collect()}
    for i in range(6):
        assert got[i] == f"Head {i} & more\nOne two three{i} éé four five\nNext"  # the box with one text on all pages is template
    assert got[10] == "" and got[11] == "" and got[12] == "plain text" and got[13] == "T\na\nb\nx\ny" and got[14] == "cut off he" and got[15].startswith("long word") and not got[15].endswith("n")
    assert wrapper.main_text(df).count() == len(rows) and wrapper.main_text(df.limit(0)).count() == 0
    assert all(r.n_chars == len(r.text) for r in wrapper.main_text(df).collect())


def test_template_texts_outlive_single_pages(spark):
    """On a large host a page cut off in a notice and one with another advert don't make either content; copies of a page are no template."""
    notice, advert = "Read this every day, dear reader.", "Buy two of these and get a third."
    page = lambda i, ad=advert, tail="</div></body></html>": f"<html><body><div class='x'>{ad}</div><div class='text'><p>Own {i}</p></div><div class='y'>{notice}{tail}"
    rows = [(i, "https://a.example/", page(i)) for i in range(40)]
    rows += [(40, "https://a.example/", page(40, "Another advert.")), (41, "https://a.example/", page(41)[: -len(notice) - 10])]
    rows += [(50 + i, "https://b.example/", page("same")) for i in range(9)] + [(60, "https://b.example/", page("other"))]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for parts in (1, 5):
        got = {r.page_id: r.text for r in wrapper.main_text(df.repartition(parts)).collect()}
        assert all(got[i] == f"Own {i}" for i in range(40)) and got[40] == "Another advert.\nOwn 40" and got[41].startswith("Own 41")
        assert all("Own same" in got[50 + i] for i in range(9)) and "Own other" in got[60]


def test_names_inside_the_article():
    page = """<article><div class='article-header'><h1>Title</h1></div><h2 id='related-work'>Related work</h2><section id='social-impact'><p>Impact.</p></section><p class='search-results-intro'>We search.</p>
      <p>A <span class='notice-term'>notice</span> is short.</p><figure><img src=x><figcaption>Figure 1</figcaption></figure><div class='share-box'><a href=a>Tweet</a> <a href=b>Mail</a></div><div class='comments'>Nice</div><nav>n</nav></article><p>out</p>"""
    assert wrapper.content(page, None, 3) == "Title\nRelated work\nImpact.\nWe search.\nA notice is short.\nFigure 1"
    assert wrapper.content("<h2 id='related-work'>Related</h2><div class='cookie-notice'>We bake</div><div id='footer'>f</div><p>Text</p>", None, 3) == "Related\nText"


def test_given_pages(spark, sf):
    import html

    for r in wrapper.main_text(spark.read.parquet(f"{sf}/pages.parquet")).join(spark.read.parquet(f"{sf}/pages.parquet"), "page_id").collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S).group(1)
        parts = re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", re.sub(r"</?(?:p|h1)>", "\0", inner))).split("\0")
        assert r.text == "\n".join(x for x in (" ".join(html.unescape(b).split()) for b in parts) if x)


def test_pipeline_by_brute_force(spark, sf):
    """Each stage on what the one before it kept, against plain code on the same rows."""
    import corpus_pipeline as P

    docs = documents(spark, sf)
    kept = []
    for name, stage in P.STAGES:
        before = docs
        docs = common.written(stage(spark, docs, sf), "test_stage")
        kept.append(docs.count())
        rows = [(r.doc_id, r.text) for r in before.collect()]
        if "language" in name:
            assert docs.count() >= 0.97 * len(rows) and docs.columns == before.columns
        if "Jaccard" in name:
            assert {r.doc_id for r in docs.collect()} == {c for _, c, _ in brute_classes(rows)} and docs.columns == before.columns
        if "substring" in name:
            cut = defaultdict(list)
            for i, a, b in brute_runs(rows):
                cut[i].append((a, b))
            want = {i: "".join(t[a:b] for a, b in zip([0, *[b for _, b in cut[i]]], [*[a for a, _ in cut[i]], len(t)], strict=True)) for i, t in rows}
            assert {r.doc_id: r.text for r in docs.collect()} == {i: t for i, t in want.items() if t.strip()} and docs.columns == before.columns
        if "mixing" in name:
            took = {r.doc_id: r.taken // r.size for r in mixing.taken(before).collect() if r.size}
            assert Counter(r.doc_id for r in docs.collect()) == Counter({i: n for i, n in took.items() if n}) and docs.columns == before.columns
        if "BPE" in name:
            assert docs.count() == len(rows) and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} == set(docs.columns)
    assert P.run(spark, sf).count() == kept[-1]


def test_written_tables_are_released(spark, sf):
    import os

    common.written(documents(spark, sf).select("doc_id"), "t")
    path = common.WRITTEN[-1]
    assert os.path.exists(path.removeprefix("file:"))
    common.release(spark)
    assert not os.path.exists(path.removeprefix("file:")) and not common.WRITTEN


def test_top_k_of_large_components(spark):
    rows = [(0, [5e7, 1.0]), (1, [5e7, -1.0]), (2, [1.0, 1.0]), (20, [-5e7, 0.0]), (3, [1e15, 1e15]), (40, [1e15, -3.0])]
    got = {}
    for r in topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    v = {i: [math.floor(64 * x) for x in e] for i, e in rows}
    for q in (0, 20, 40):
        best = sorted(((-sum(a * b for a, b in zip(v[q], v[i])), i) for i in v if i != q))
        assert sorted(got[q]) == [(n + 1, i, max(-(2**63), min(2**63 - 1, -s))) for n, (s, i) in enumerate(best)]


def test_mixing_sources_that_share_ids(spark):
    """A document that fits one source's tail is not taken in another one that has the same ids."""
    rng = random.Random(4)
    rows = [(i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(1, 30))), s) for s in ("a", "b", "c") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    sums = {}
    for r in mixing.taken(df).collect():
        t = sums.setdefault(round(r["target"], 6), [0, r["target"]])
        t[0] += r["taken"]
    assert len(sums) == 3
    for got, want in sums.values():
        assert abs(got - want) <= 30


def test_deep_nesting_and_teaser_articles():
    deep = "<div>" * 5_000 + "<p>Deep text stays.</p>" + "</div>" * 5_000 + "<p>After.</p>"
    assert wrapper.content(deep, None, 3) == "Deep text stays.\nAfter."
    long = "A long paragraph of the page itself. " * 20
    assert wrapper.content(f"<main><h1>Title</h1><p>{long}</p><article class='teaser'>See also this.</article></main>", None, 3).startswith("Title\nA long")
    assert "A long" in wrapper.content(f"<div><p>{long}</p></div><article>Teaser.</article>", None, 3)
    assert wrapper.content(f"<div>Some side text.</div><article><p>{long}</p></article>", None, 3) == long.strip()


def test_taken_is_what_the_shards_drew(spark):
    rows = [(i, "w " * (1 + i % 9), "abc"[i % 3]) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r["doc_id"]: r for r in mixing.taken(df, shards=8).collect()}
    want: dict = {}
    for r in mixing.mixed(df, shards=8).collect():
        want.setdefault(r["doc_id"], []).append(r["shard"])
    assert {d: sorted(r["shards"]) for d, r in got.items() if r["shards"]} == {d: sorted(x) for d, x in want.items()}
    assert all(r["taken"] == r["size"] * len(want.get(d, [])) for d, r in got.items())
