import re
from pathlib import Path

from helpers import documents, odd_rows

from ledgerloom.llm import host_rules, length_buckets, shard_shuffle, url_rules
from ledgerloom.llm.common import prepare


def measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    tri = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, t in enumerate(tri) if tri.count(t) > 1 for k in range(3)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_measures(spark):
    rows = [r for r in odd_rows() if len(r[1] or "") < 1000] + [
        (20, "a b c a b c a b c"), (21, "x y z " * 30), (22, "# $ % &&& <b>|*\nsame\nsame\n same\nsame"), (23, "p q r s p q r t u p q r"),
        (24, " ".join(f"w{i}" for i in range(60))), (25, " ".join(f"w{i % 40}" for i in range(120)))]
    hosts = [(i, t, f"host {k}") for k, (i, t) in enumerate(rows)]  # of one document each: none is rejected
    got = sorted((tuple(r) for r in host_rules.query(documents(prepare(spark), hosts)).collect()), key=repr)
    want = sorted(((i, *measures(t), not measures(t)[-1]) for i, t in rows), key=repr)
    assert got == want
    assert host_rules.query(documents(spark, [])).collect() == []


def test_bad_host(spark):
    """A host whose documents nearly all fail loses its good one too; a null host is a host."""
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(k, "bad", "spam") for k in range(40)] + [(100, good, "spam")] + [(200 + k, good, "fine") for k in range(20)]
    rows += [(300 + k, good, f"h{k}") for k in range(10)] + [(400, good, None), (401, "bad", None)]
    kept = {r.doc_id for r in host_rules.query(documents(prepare(spark), rows)).collect() if r.kept}
    assert kept == {*range(200, 220), *range(300, 310), 400}


def test_urls(spark):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/es/1", "allow"), ("a.example.org", "/", "block"), ("com", "/fr/", "allow"),
             ("com", "", "block"), ("com", "", "allow"), ("b.c.com", "/fr", "block")]
    urls = [None, "", "no scheme", "://", "http://", "http:///x", "https://Example.ORG/es/12?q#f", "http://x.example.org/es/2", "http://badexample.org/es/1",
            "http://org", "http://org/", "http://a.example.org/es/1", "http://z.a.example.org/q", "http://com?x=/fr/", "http://c.com/fr/1", "http://b.c.com/fr", "http://b.c.com/fr/2",
            "http://d.b.c.com/fr/2#a", "a://b://c.com/fr/", "http://example.org./es/", "http://c.com:80/fr/", "http://com/fr/\n?z", "HTTP://É.com/fr/"] * 2

    def judged(u):
        rest = u.partition("://")[2] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        return host, path, best and best[2], best[3] if best else "allow"
    prepare(spark)
    table = spark.createDataFrame([(k, u, 1, "k") for k, u in enumerate(urls)], "page_id int, url string, part int, key string")
    out = url_rules.judge(table, spark.createDataFrame(rules, "host string, path string, verdict string")).orderBy("page_id").collect()
    assert [(r.url_host, r.url_path, r.url_rule, r.url_verdict) for r in out] == [judged(u) for u in urls]
    assert url_rules.query(spark, table.limit(0)).collect() == []


def test_shards(spark):
    rows = odd_rows() + [(1000 + k, "same" if k % 3 else f"text {k}") for k in range(600)]
    out = shard_shuffle.query(documents(prepare(spark), rows)).collect()
    assert sorted((r.doc_id, r.size) for r in out if r.doc_id) == sorted((i, len((t or "").encode()) + 8) for i, t in rows if i)
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
        assert 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24) and r.law == "key"
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert len({(r.doc_id, r.shard) for r in out}) == len({r.doc_id for r in out})
    assert sorted(map(tuple, shard_shuffle.query(documents(spark, rows)).collect()), key=repr) == sorted(map(tuple, out), key=repr)
    assert shard_shuffle.query(documents(spark, [])).collect() == []


def test_many_buckets_per_shard(spark):
    prepare(spark)
    df = spark.range(2000).selectExpr("id AS doc_id", "repeat('x', 100) AS text", "100L AS size")
    out = shard_shuffle.shard(df, ["doc_id", "text", "size"], n_shards=3, size="size", bucket_bytes=9000).collect()
    assert sorted(r.doc_id for r in out) == list(range(2000))
    for s in range(3):
        mine = sorted((r.slot, r.doc_id) for r in out if r.shard == s)
        assert [x[0] for x in mine] == list(range(len(mine)))
        assert [x[1] for x in mine] != sorted(x[1] for x in mine)


def test_boundaries():
    import itertools
    import random

    import numpy as np
    rng = random.Random(2)
    for _ in range(30):
        lengths = sorted(rng.sample(range(60), rng.randint(1, 9)))
        counts = [rng.randint(1, 9) for _ in lengths]

        def padding(bounds):
            return sum(c * (max(next(b for b in bounds if b >= x), 1) - x) for x, c in zip(lengths, counts, strict=True))
        for k in (1, 2, 3, 4):
            best = min(padding([*cut, lengths[-1]]) for m in range(k) for cut in itertools.combinations(lengths[:-1], min(m, len(lengths) - 1)))
            got = length_buckets.boundaries(np.array(lengths), np.array(counts), k)
            assert len(got) <= max(k, 1) and padding(got) == best, (lengths, counts, k)


def test_packing(spark, monkeypatch):
    import random
    monkeypatch.setattr(length_buckets, "BLOCK_ROWS", 20)
    rng = random.Random(6)
    rows = odd_rows() + [(1000 + k, "w " * rng.randint(0, 40)) for k in range(300)]
    out = length_buckets.query(documents(prepare(spark), rows)).collect()
    assert sorted((repr(r.doc_id), r.tokens) for r in out) == sorted((repr(i), len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t in rows)
    seats = {}
    for r in out:
        assert r.tokens <= r.length
        seats.setdefault((r.bucket, r.length), []).append((r.batch, r.slot))
    for (_, length), v in seats.items():
        room = max(length_buckets.BUDGET // max(length, 1), 1)
        assert sorted(b * room + s for b, s in v) == list(range(len(v)))
    assert length_buckets.query(documents(spark, [])).collect() == []


def test_shards_are_written_whole(spark):
    """The query's figures are those of shard files that hold every text, in slot order."""
    root = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:")) / "llm"
    before = set(root.glob("shards-*"))
    rows = odd_rows() + [(100 + k, "long text " * (k % 7) * 200) for k in range(300)]
    out = shard_shuffle.query(documents(prepare(spark), rows)).collect()
    (folder,) = set(root.glob("shards-*")) - before
    written = spark.read.parquet(str(folder)).select("doc_id", "text", "shard", "slot").collect()
    assert sorted(((r.doc_id, r.text) for r in written), key=repr) == sorted(rows, key=repr)
    want = sorted((r.shard, r.slot, repr(r.doc_id), len((r.text or "").encode()) + 8) for r in written)
    assert sorted((r.shard, r.slot, repr(r.doc_id), r.size) for r in out) == want
