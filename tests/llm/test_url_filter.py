import random
import re

from pyspark.sql import functions as F

from eventlake.llm import queries, url_filter
from tests.llm.oracle import same

RULES = queries.URL_RULES


def brute(url, listed):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        raw = re.match(r"[^/?#]*", rest)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in raw)
        path = re.match(r"[^?#]*", rest[len(raw) :])[0]
    fit = [(len(h + p), h + p, v) for v, h, p in RULES if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fit, default=(0, None, None))
    return host, path, rule, verdict or ("block" if host in listed else "allow"), host in listed


def test_against_brute(spark, monkeypatch):
    rng = random.Random(3)
    parts = ["com", "net", "example.com", "www.example.com", "a.example.net", "org", "É.Org", "xcom"]
    urls = [None, "", "no scheme", "://", "http://", "x://com", "http://NET/es/1", "http://a.com?x=://y/", "http://b.net/es", "h://net\n/es/"]
    urls += [f"http://h{rng.randrange(400)}.{rng.choice(parts)}/{rng.choice(['en/', 'es/', 'fr/', ''])}{rng.choice(['', '?q', '#f/'])}" for _ in range(1500)]
    hosts = sorted({brute(u, ())[0] for u in urls})
    listed = set(rng.sample(hosts, 150)) - {""}
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls + urls[:20])], "id long, url string, host string")
    keys = spark.createDataFrame([(h,) for h in [*listed, None, "", "not.in.corpus"]], "k string")
    for bits, limit, together in ((12, 1 << 28, 16), (2, 1 << 28, 16), (12, 512, 2)):
        monkeypatch.setattr(url_filter, "PASS_CHUNKS", together)
        plan = url_filter.judge_urls(df, "id", "url", RULES, keys, bits, limit)
        assert not re.search("Python|Pandas|Arrow|Join", plan._jdf.queryExecution().toString())
        got = plan.collect()
        assert len(got) == len(urls) + 20
        for r in got:
            assert tuple(r)[1:] == brute((urls + urls[:20])[r.id], listed)
    none = url_filter.judge_urls(df, "id", "url", RULES, keys.limit(0))
    assert none.where("listed").count() == 0
    assert url_filter.judge_urls(df.limit(0), "id", "url", RULES, keys).count() == 0


def test_native(spark, sf_dir):
    plan = queries.op10_urls(spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Join", plan)


def test_query(spark, sf_dir):
    assert same(spark, "op10_urls", queries.op10_urls, queries.OP10_SQL, sf_dir)
