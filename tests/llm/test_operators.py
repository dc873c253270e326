"""Training-data operators against brute force, exact round trips and held-out accuracy, on whole small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from casekit.llm import bpe, components, fingerprint, licenses, mixing, ngram_join, quality, quotes, revisits, secrets, toxicity
from casekit.llm import queries as Q
from casekit.llm.common import table

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copy_no string, cls string, score string"
ROWS = [
    (1, "a b c d e f g h " * 40, "en", "s", 3, "x", "y", "z"),
    (1, "a b c d e f g h " * 40, "en", "s", 3, "x", "y", "z"),  # repeated row
    (2, None, None, None, None, None, None, None),
    (None, "token = abcdef123 words here", None, "t", 1, None, None, None),
    (3, "", "de", "s", 0, "", "", ""),
    (4, "w" * 50_000, "de", "s", 0, "", "", ""),
    (5, "x y " * 20_000, "de", None, 0, "", "", ""),
    (6, "one", None, "s", 1, "", "", ""),
]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(params=["edge", "empty"])
def odd(request, spark):
    rows = ROWS if request.param == "edge" else []
    labels = [(1, 1, 0), (2, 0, 1), (None, 1, 1), (4, None, None), (5, 0, 1), (6, 1, 0), (3, 1, 0)] if rows else []
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), len(rows)


def test_edge_rows_give_one_row_each(odd):
    """Nulls, empty and long texts, repeated rows, empty tables, clashing extra columns."""
    docs, labels, n = odd
    assert quality.judge(docs, quality.fit(docs, labels)).count() == n
    assert bpe.encode_digests(docs, PATH).count() == n
    assert secrets.scan(docs).count() == n
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == n
    assert fingerprint.fingerprints(docs).count() == n
    assert licenses.scan(docs.withColumn("path", F.concat(F.lit("a/b/LICENSE"), F.col("doc_id").cast("string")))).count() == n
    assert secrets.redact(docs).columns == docs.columns
    joined = ngram_join.join(docs).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in joined) == sorted((r[0] or 0, r[0] or 0) for r in (ROWS if n else []))
    assert ngram_join.keep_one(docs).count() == max(0, n - 1)  # one of the two rows of document 1 stays
    mixed = mixing.replicate(docs)
    assert mixed.columns == [c for c in docs.columns if c != "copy_no"] + list(mixing.OUT)
    again = mixed.where("doc_id = 1").groupBy("n_copies").count().collect()
    assert all(r["count"] == 2 * r.n_copies for r in again)


# ---- 1 ----

def brute_quality(text):
    w = words(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    windows = defaultdict(list)
    for i in range(len(w) - 7):
        windows[tuple(w[i:i + 8])].append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_quality_counts_match_brute_force(spark, docs, texts):
    got = Q.op1_quality_rules(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_forest_is_monotone_and_flat_scoring_agrees_with_walking():
    rng = np.random.default_rng(5)
    x = rng.random((600, 3))
    y = ((x[:, 0] + 0.3 * rng.random(600)) > 0.6).astype(float)
    forest = quality.grow(x, y, [1, -1, 0], trees=20)
    grid = np.tile(x[:50], (1, 1))
    for j, sign in ((0, 1), (1, -1)):
        before = None
        for v in np.linspace(0, 1, 21):
            grid[:, j] = v
            p = forest.margin(grid)
            assert before is None or ((p - before) * sign >= -1e-12).all()
            before = p
    for row in x[:20]:
        total = forest.base
        for at in forest.roots:
            while forest.feature[at] >= 0:
                at = forest.left[at] if row[forest.feature[at]] <= forest.threshold[at] else forest.right[at]
            total += forest.value[at]
        assert total == pytest.approx(float(forest.margin(row[None])[0]))


def test_quality_held_out_accuracy(spark):
    sf = SF.replace("0.001", "0.01")
    got = Q.op1_quality_rules(spark, sf).toPandas().set_index("doc_id").kept
    labels = table(spark, sf, "labels").toPandas().set_index("doc_id").quality
    held = [i for i in labels.index if zlib.crc32(str(i).encode()) % 5 == 0]
    assert (got.loc[held].astype(int) == labels.loc[held]).mean() > 0.95


# ---- 2 ----

def test_quotes_link_levels_and_order(spark):
    rows = [("L", "m1", 1, "Hello there\nSecond line"), ("L", "m2", 2, "> hello   THERE\nI agree"),
            ("L", "m3", 3, "On Monday m1 wrote:\n> I agree\n> > Hello there\nMe too"), ("L", "m4", 4, "> never said\nHm"),
            ("K", "k1", 9, "> I agree\nother list"), ("L", None, 5, "> I agree"), ("L", "m5", 6, None)]
    got = quotes.conversations(spark.createDataFrame(rows, "list_id string, message_id string, sent_at long, body string")).collect()
    by = {r.message_id: r for r in got}
    assert {k: (r.conversation_id, r.depth, r.parent_id) for k, r in by.items() if k} == {
        "m1": ("m1", 0, None), "m2": ("m1", 1, "m1"), "m3": ("m1", 2, "m2"), "m4": ("m4", 0, None), "k1": ("k1", 0, None), "m5": ("m5", 0, None)}
    assert by["m3"].own_text == "Me too" and by["m3"].deepest == 2 and by["m3"].n_linked == 2 and by["m4"].n_linked == 0
    order = [r.message_id for r in got if r.conversation_id == "m1"]
    assert order == ["m1", "m2", "m3"]


def test_quote_threads_rebuild_the_stand_in(spark):
    said = Q.messages_from_conversations(spark, SF).collect()
    got = {r.message_id: r for r in Q.op2_quote_threads(spark, SF).collect()}
    assert len(got) == len(said)
    origin = {}
    norm = lambda s: re.sub(r"[ \t\r]+", " ", s).lower().strip()
    for r in sorted(said, key=lambda r: (r.sent_at, r.message_id)):
        for line in r.body.split("\n"):
            if not line.lstrip().startswith(">") and norm(line):
                origin.setdefault((r.list_id, norm(line)), (r.sent_at, r.message_id))
    for r in said:
        votes = Counter()
        for line in r.body.split("\n"):
            m = re.match(r"^[ \t]*((?:>[ \t]*)*)", line)
            level, rest = m[1].count(">"), norm(line[m.end():])
            o = origin.get((r.list_id, rest))
            if level and rest and o and o[0] < r.sent_at:
                votes[-level, o] += len(rest)
        best = max(votes, key=lambda k: (k[0], votes[k], k[1]), default=None)
        assert got[r.message_id].parent_id == (best[1][1] if best else None)


# ---- 3 ----

def test_mixing_counts_match_inverse_distribution(spark, docs):
    got = Counter(r.doc_id for r in mixing.replicate(docs).select("doc_id").collect())
    rows = docs.select("doc_id", "text", "source").collect()
    chars = Counter()
    for r in rows:
        chars[r.source] += len(r.text)
    total = sum(chars.values())
    for r in rows:
        rate = total / len(chars) / chars[r.source]
        u = int(hashlib.md5(f"{mixing.SEED}:1:{r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        p = c = np.exp(-rate)
        n = 0
        while c <= u and n < 200:
            n += 1
            p *= rate / n
            c += p
        assert got[r.doc_id] == n


def test_mixing_follows_weights_and_large_rates(spark):
    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("abcd").alias("text"),
                                 F.when(F.col("id") < 2, "rare").otherwise("rest").alias("source"))
    got = mixing.replicate(d, {"rare": 1.0, "rest": 1.0})
    by = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
    assert abs(by["rare"] - 2000) < 250 and abs(by["rest"] - 2000) < 250
    key = [r.shuffle_key for r in got.select("shuffle_key").collect()]
    assert len(set(key)) == len(key)


# ---- 4 ----

def test_bpe_equals_the_library_and_round_trips():
    lib, own = Tokenizer.from_file(PATH), bpe.Codec(PATH)
    rnd = random.Random(3)
    some = ["", "<|endoftext|>", "a<|endoftext|>b", "aaaa" * 3000, " " * 3000, "x\n\n \ty'll 12é漢😀"]
    some += ["".join(rnd.choice("ab the<|endoftext|>'s \n\t1é漢😀") for _ in range(rnd.randint(0, 80))) for _ in range(500)]
    some += [f"a{chr(c)}b {chr(c)} {chr(c)}{chr(c)}  x" for c in range(0x3000)]
    for text, ids, ref in zip(some, own.encode(some), lib.encode_batch(some, add_special_tokens=False)):
        assert ids == ref.ids
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False) == text


def test_bpe_query_digests(spark, texts):
    lib = Tokenizer.from_file(PATH)
    for r in Q.op4_bpe_round_trip(spark, SF).collect():
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(texts[r.doc_id]))


# ---- 5 ----

def test_revisits_resolve_as_of_with_validators(spark):
    h = lambda **k: [(a.replace("_", "-"), v) for a, v in k.items()]
    day = 86_400
    rows = [
        ("a", "response", "http://X.com:80/p?b=2&a=1#f", 1 * day, 200, '"1"', None, h(ETag='"1"', Content_Type="t", Date="d1"), "one"),
        ("b", "response", "http://x.com/p?a=1&b=2", 5 * day + 10, 200, '"2"', None, h(ETag='"2"', Date="d2"), "two"),
        ("c", "response", "http://x.com/p?a=1&b=2", 6 * day, 404, None, None, [], "gone"),
        ("v1", "revisit", "HTTP://x.com/p?utm_source=q&a=1&b=2", 3 * day, 304, 'W/"1"', None, h(Date="d3", Content_Length="0"), None),
        ("v2", "revisit", "http://x.com/p?b=2&a=1", 5 * day + 10, 304, '"1"', None, [], None),  # same second as b: not earlier
        ("v3", "revisit", "http://x.com/p?b=2&a=1", 9 * day, 304, '"1"', None, [], None),
        ("v4", "revisit", "http://x.com/p?b=2&a=1", 9 * day, 304, None, None, None, None),
        ("v5", "revisit", "no url", 9 * day, 304, None, None, None, None), ("v6", "revisit", None, None, 304, None, None, None, None)]
    got = {r.record_id: r for r in revisits.resolve(spark.createDataFrame(
        rows, "record_id string, warc_type string, target_uri string, warc_date long, http_status int, etag string, last_modified string, "
              "headers array<struct<name:string,value:string>>, payload string")).collect()}
    assert {k: (r.original_id, r.verdict, r.payload) for k, r in got.items()} == {
        "v1": ("a", "resolved", "one"), "v2": ("a", "resolved", "one"), "v3": ("b", "validator_mismatch", None),
        "v4": ("b", "unvalidated", "two"), "v5": (None, "no_original", None), "v6": (None, "no_original", None)}
    assert [(x.name, x.value) for x in got["v1"].headers] == [("content-type", "t"), ("date", "d3"), ("etag", '"1"')]


def test_revisits_query_matches_brute_force(spark):
    recs = Q.records_from_pages(spark, SF).withColumn("url", revisits.canonical(F.col("target_uri"))).collect()
    full = defaultdict(list)
    for r in recs:
        if r.warc_type == "response":
            full[r.url].append((r.warc_date, r.record_id, r.etag))
    exp = {}
    for r in recs:
        if r.warc_type == "revisit":
            o = max((x for x in full[r.url] if x[0] < r.warc_date), default=None)
            exp[r.record_id] = (o and o[1], "no_original" if o is None else "resolved" if o[2] == r.etag else "validator_mismatch")
    assert {r.record_id: (r.original_id, r.verdict) for r in Q.op5_warc_revisits(spark, SF).collect()} == exp


# ---- 6 ----

def test_secret_base_spans_match_brute_force(spark, texts):
    assign = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for r in Q.op6_secret_scan(spark, SF).collect():
        t = texts[r.doc_id]
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in spans) for i in range(3))
        joined = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))
        assert r.base_sha256 == sha(joined)
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def test_random_tokens_are_found_and_prose_is_not(spark):
    rnd = random.Random(1)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(rnd.choice(chars) for _ in range(40)) for _ in range(30)]
    prose = ["internationalization", "thequickbrownfoxjumpsoverthelazydog", "counterrevolutionaries", "xyzxyzxyzxyzxyzxyzxyzxyz"]
    rows = [(i, f"see {k} now") for i, k in enumerate(keys)] + [(100 + i, f"see {w} now") for i, w in enumerate(prose)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secrets.scan(d).collect()}
    assert sum(got[i] == "random:4:44" for i in range(30)) >= 28
    assert all(got[100 + i] == "" for i in range(len(prose)))
    assert secrets.fisher(secrets.battery("0123456789abcdef" * 3)) < 1e-3  # even but serially correlated
    clean = {r.doc_id: r.text for r in secrets.redact(d).collect()}
    assert clean[100] == "see internationalization now" and sum(clean[i] == "see [secret] now" for i in range(30)) >= 28


# ---- 7 ----

def test_toxicity_held_out_and_inserted_characters(spark):
    sf = SF.replace("0.001", "0.1")
    got = Q.op7_toxicity(spark, sf).toPandas().set_index("doc_id")
    labels = table(spark, sf, "labels").toPandas().set_index("doc_id").toxic
    assert got.score.between(0, 1).all() and ((got.score >= 0.5).astype(int) == got.predicted).all()
    held = [i for i in labels.index if zlib.crc32(str(i).encode()) % 5 == 0]
    assert got.held_out.loc[held].all()
    p, y = got.score.loc[held], labels.loc[held]
    rank = p.rank()
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    assert (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) > 0.9
    assert (p[y == 0] < 0.5).mean() > 0.99


def test_kernel_tolerates_gaps():
    code = lambda w: toxicity.letters(w)[0]
    k = toxicity.kernel([code("idiot"), code("idi-ot"), code("idioot"), code("1d1ot"), code("nation")], [code("idiot")])[:, 0]
    assert k[0] == pytest.approx(1, abs=1e-5) and k[1] > 0.5 and k[2] > 0.5 and k[3] == pytest.approx(1, abs=1e-5) and k[4] < 0.05
    assert toxicity.tokens("you i d i o t") == ["you", "idiot"]


# ---- 8 ----

def test_fingerprints_follow_the_next_document(spark, texts):
    ids = sorted(texts)
    got = {r.doc_id: r for r in Q.op8_weighted_fingerprints(spark, SF).collect()}
    for i, j in zip(ids, ids[1:] + ids[:1]):
        t, n = texts[i], len(texts[i])
        assert got[i].n_chars == n and got[i].edited_sha256 == sha(t[:n - n // 2] + texts[j][:n // 2])
        same = np.mean([got[i].fingerprint[k:k + 4] == got[j].fingerprint[k:k + 4] for k in range(0, 256, 4)])
        assert got[i].near_next == pytest.approx(same)
    by = defaultdict(set)
    for i in ids:
        by[texts[i]].add(got[i].fingerprint)
    assert all(len(x) == 1 for x in by.values())


def test_collision_rate_is_generalised_jaccard():
    rnd, err, size = random.Random(1), [], []
    for _ in range(300):
        a = [f"w{rnd.randrange(12)}" for _ in range(rnd.randint(5, 80))]
        b = a[:rnd.randint(1, len(a))] + [f"w{rnd.randrange(12)}" for _ in range(rnd.randint(0, 30))]
        x, y = (Counter(zip(w, w[1:])) if len(w) > 1 else Counter(w) for w in (a, b))
        j = sum((x & y).values()) / sum((x | y).values())
        s = fingerprint.signatures([" ".join(a).encode(), " ".join(b).encode()])
        err.append(float((s[0] == s[1]).mean()) - j)
        size.append(j * (1 - j) / fingerprint.SAMPLES)
    assert abs(np.mean(err)) < 0.015 and np.sqrt(np.mean(np.square(err))) < 1.3 * np.sqrt(np.mean(size))


# ---- 9 ----

def shingles(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(text)]
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i:i + 5]) for i in range(len(w) - 4)])


def brute_components(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = [i for i in sorted(texts) if sets[i]]
    for x, i in enumerate(ids):
        for j in ids[:x]:
            a, b = sets[i], sets[j]
            if 10 * min(len(a), len(b)) >= 8 * max(len(a), len(b)):
                same = len(a & b)
                if 100 * same >= 80 * (len(a) + len(b) - same):
                    u, v = sorted((find(i), find(j)))
                    root[v] = u
    return {i: (len(sets[i]), find(i)) for i in texts}


def near_copies(seed, groups=12, sizes=(2, 40)):
    """Texts around the threshold: copies of originals with a few words changed, dropped or added."""
    rnd, out = random.Random(seed), {}
    for _ in range(groups):
        base = [f"v{rnd.randrange(5000)}" for _ in range(rnd.randint(4, 120))]
        for _ in range(rnd.randint(*sizes)):
            w = list(base)
            for _ in range(rnd.randint(0, 4)):
                k = rnd.randrange(len(w))
                w[k:k + rnd.randint(0, 1)] = [f"n{rnd.randrange(10**6)}"] * rnd.randint(0, 2)
                w = w or ["x"]
            out[len(out)] = " ".join(w)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_loses_no_link(spark, monkeypatch, seed):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)  # several blocks to a run
    texts = near_copies(seed)
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(d).collect()}
    assert got == brute_components(texts)


def test_ngram_join_query(spark, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in Q.op9_ngram_join(spark, SF).collect()}
    assert got == brute_components(texts)


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(2)
    for _ in range(400):
        n = int(rng.integers(4, 400))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        out = int(rng.integers(0, len(a) // 5 + 1))
        b = np.unique(np.r_[rng.permutation(a)[out:], rng.integers(0, 2**63, int(rng.integers(0, 3))).astype(np.uint64)])
        if ngram_join.linked(a, b):
            assert (a.tobytes() == b.tobytes()) or len(np.intersect1d(ngram_join.signatures(a), ngram_join.signatures(b)))


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)]
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(300)}}


# ---- 10 ----

def test_license_templates_and_inheritance(spark):
    rows = [(1, "p/LICENSE", "Released under the MIT License."), (2, "p/a/x.py", "def f(): pass"), (3, "p/a/COPYING", "Licensed under the Apache License, Version 2.0."),
            (4, "p/a/b/y.py", "nothing here"), (5, "q/z.py", "nothing"), (6, "p/c/w.py", "intro\nThis work is licensed under the GNU General\nPublic License, version 3.\nend"),
            (7, None, "text"), (8, "p/v.py", None)]
    got = {r.doc_id: (r.license, r.granted_by) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {1: ("MIT", "own"), 2: ("Apache-2.0", "p/a"), 3: ("Apache-2.0", "own"), 4: ("Apache-2.0", "p/a"), 5: (None, None),
                   6: ("GPL-3.0", "own"), 7: (None, None), 8: ("MIT", "p")}


def test_license_cosine_matches_brute_force(texts):
    index = licenses.Index()
    vectors = []
    for name, notices in licenses.TEMPLATES.items():
        for t in notices:
            vectors.append((name, Counter(licenses.WORD.findall(t.lower()))))
    idf = lambda w: index.idf.get(w, index.other)
    norm = lambda c: sum((k * idf(w))**2 for w, k in c.items())**0.5

    def brute(text):
        best, lines = (0.0, 0, None), text.lower().split("\n")
        for i, line in enumerate(lines):
            for part in (line, " ".join(lines[i:i + 2])):
                c = Counter(licenses.WORD.findall(part))
                for name, v in sorted(vectors, key=lambda x: x[0]):
                    x = round(sum(c[w] * v[w] * idf(w)**2 for w in v) / norm(c) / norm(v), 9) if c else 0
                    if x >= licenses.LEAST and x > best[0] + 1e-8:
                        best = (x, i + 1, name)
        return best[2], best[0], best[1]

    for t in texts.values():
        got, exp = index.scan(t), brute(t)
        assert (got[0], got[2]) == (exp[0], exp[2]) and got[1] == pytest.approx(exp[1], abs=1e-8)


APACHE = "Licensed under the Apache License, Version 2.0."
GNU = ("This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU {} as published by\n"
       "the Free Software Foundation, either version {} of the License, or\n(at your option) any later version.")


@pytest.mark.parametrize("text,name", [
    ("# SPDX-License-Identifier: MIT", "MIT"), ("SPDX-License-Identifier: MPL-2.0", "MPL-2.0"), ("SPDX-License-Identifier: GPL-3.0-only", "GPL-3.0"),
    ("SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause"), ("x\n// spdx-license-identifier: (mit or Apache-2.0) and Foo-1.0 */", "(MIT OR Apache-2.0) AND Foo-1.0"),
    (GNU.format("General Public License", 3), "GPL-3.0"), (GNU.format("General Public License", 2), "GPL-2.0"),
    (GNU.format("Affero General Public License", 3), "AGPL-3.0"), (GNU.format("Lesser General Public License", "2.1"), "LGPL-2.1"),
    ("Licensed under CC BY 4.0.", "CC-BY-4.0"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("Licensed under CC BY-NC-SA 3.0.", "CC-BY-NC-SA-3.0"),
    ("Licensed under CC0 1.0.", "CC0-1.0"), (" ".join(["word"] * 15) + " " + APACHE + " " + " ".join(["other"] * 15), "Apache-2.0"),
    ("some\nprose " + APACHE.replace(" License,", "\nLicense,\n") + " and more prose", "Apache-2.0"),
    ("Copyright 2020 X\n\n" + licenses.MORE["MIT"][2].replace(", ", ",\n"), "MIT"), ("Copyright\n" + licenses.MORE["ISC"][1].replace(", ", ",\n"), "ISC"),
    ("Copyright\n" + licenses.MORE["BSD-2-Clause"][0].replace(". ", ".\n"), "BSD-2-Clause"),
    ("Copyright\n" + licenses.MORE["BSD-3-Clause"][0].replace(". ", ".\n"), "BSD-3-Clause"),
    ("This is free and unencumbered software released into the public domain.", "Unlicense"),
    ("Die Katze kam mit dem Hund", None), ("Released under the terms that follow", None), ("The general public may use it", None)])
def test_licenses_beside_the_first_five(text, name):
    got = licenses.Index(licenses.ALL, licenses.NEED, licenses.BARRED).own(text)
    assert got[0] == name


@pytest.mark.parametrize("name,length,least", [
    ("hex", 32, 0.95), ("HEX", 40, 0.95), ("lower", 32, 0.8), ("lower", 64, 0.95), ("upper", 32, 0.8), ("upper", 64, 0.95), ("base32", 52, 0.95),
    ("base32 lower", 52, 0.95), ("alnum lower", 32, 0.95), ("alnum lower", 64, 0.95), ("alnum upper", 32, 0.95), ("alnum upper", 40, 0.95),
    ("alnum upper", 64, 0.95), ("alnum", 32, 0.95), ("alnum", 64, 0.95), ("base64", 40, 0.95), ("base64", 64, 0.95)])
def test_recall_of_each_alphabet(name, length, least):
    """Share of random tokens at a p-value of 10^-5 that the battery doesn't reject."""
    rnd, alphabet = random.Random(7), dict(secrets.ALPHABETS)[name]
    tokens = ["".join(rnd.choice(alphabet) for _ in range(length)) for _ in range(400)]
    assert np.mean([secrets._cell(t, secrets.RANDOM_LEVEL) >= 34 for t in tokens]) >= least


def test_parts_of_tokens_are_found_on_their_own(spark):
    rnd = random.Random(3)
    draw = lambda chars, n: "".join(rnd.choice(chars) for _ in range(n))
    lower = "abcdefghijklmnopqrstuvwxyz0123456789"
    keys = [f"xoxb-{draw('0123456789', 12)}-{draw('0123456789', 12)}-{draw(lower + lower[:26].upper(), 24)}" for _ in range(40)]
    keys += [f"sk_live_{draw(lower, 32)}" for _ in range(40)]
    plain = ["some-long-name-of-a-configuration-option", "test_recall_of_each_alphabet_in_the_table", "1234567890-2345678901-98765432101234567"]
    d = spark.createDataFrame([(i, f"see {k} now") for i, k in enumerate(keys + plain)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secrets.scan(d).collect()}
    clean = {r.doc_id: r.text for r in secrets.redact(d).collect()}
    core = [i for i, k in enumerate(keys) if got[i] and re.split("[-_]", k)[-1] not in clean[i]]
    assert len(core) >= 76 and all(got[i].count("random") == 1 for i in core)
    assert all(got[len(keys) + i] == "" for i in range(len(plain)))


def test_keep_one_decides_by_text_where_ids_repeat(spark):
    rnd = random.Random(4)
    base = {k: [f"{k}{rnd.randrange(10**6)}" for _ in range(60)] for k in "abcdefg"}
    t = {k: " ".join(w) for k, w in base.items()}
    near = {k: " ".join([*w[:-1], "changed"]) for k, w in base.items()}
    rows = [(1, t["a"], "s"), (1, t["b"], "s"), (1, None, "s"), (1, "", "s"),      # two texts without likeness, and empty ones: all stay
            (2, near["a"], "s"), (2, t["c"], "s"), (2, t["c"], "s"),              # a copy of 1 goes, the text of its own stays once
            (3, t["d"], "s"), (3, near["d"], "s"), (4, t["d"], "s"),              # like texts of one id: one row
            (5, t["e"], "s"), (5, t["e"], "s"), (6, t["e"], "s"),                 # equal rows: one row
            (7, "", "s"), (7, "", "s"), (None, t["a"], "s"), (8, t["f"], "s"), (9, near["f"], "s"), (9, t["g"], "s"), (10, near["b"], "s")]
    kept = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string, class_of_row string")).collect()
    got = Counter((r.doc_id, r.text) for r in kept)
    three = [k for k in got if k[0] == 3]
    assert len(three) == 1 and got.pop(three[0]) == 1 and three[0][1] in (t["d"], near["d"])
    assert got == Counter([(1, t["a"]), (1, t["b"]), (1, None), (1, ""), (2, t["c"]), (5, t["e"]), (7, ""), (7, ""), (None, t["a"]), (8, t["f"]), (9, t["g"])])


def test_fingerprints_of_repeated_ids_and_null_ids(spark, monkeypatch):
    """Rows of one id, or of none, go out in batches of a few texts; each is followed by the least text of the next id."""
    rnd = random.Random(6)
    draw = lambda: " ".join(f"w{rnd.randrange(300)}" for _ in range(rnd.randint(1, 40)))
    rows = [(i, draw()) for i in [*range(0, 3000, 7), *[14] * 700, *[2996] * 3, *[0] * 3, *[None] * 300]] + [(21, None), (None, None)]
    got = fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts, ids = defaultdict(list), sorted({i for i, _ in rows if i is not None})
    for i, t in rows:
        texts[i].append(t or "")
    following = {i: min(texts[j]) for i, j in zip(ids, ids[1:] + ids[:1])} | {None: ""}
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == Counter(
        (i, len(t), sha(t[:len(t) - len(t) // 2] + following[i][:len(t) // 2])) for i, of in texts.items() for t in of)
    most = []
    monkeypatch.setattr(fingerprint, "SLICE", 2000)
    monkeypatch.setattr(fingerprint, "_fingerprint", lambda r, real=fingerprint._fingerprint: most.append(len(r)) or real(r))
    same = pa.RecordBatch.from_pylist([{"doc_id": None, "text": "some words", "following": ""}] * 5000)
    assert sum(b.num_rows for b in fingerprint._each([same])) == 5000 and max(most) <= 201
