import random
from datetime import date, timedelta

from inkveil.llm import urlfilter


def brute(url, day, events):
    from urllib.parse import urlsplit

    if not url or day is None or "://" not in url:
        return None
    u = urlsplit(url)
    host = (u.hostname or "").rstrip(".")
    if not host:
        return None
    found = []
    own = lambda k: (k.split("/")[0].lower() + k[len(k.split("/")[0]) :]).rstrip("/")
    for key in {own(k) for k, d, a in events if k is not None}:
        domain, _, path = key.partition("/")
        if not (host == domain or host.endswith("." + domain)) or path and not (u.path + "/").startswith(f"/{path}/"):
            continue
        past = [(d, a == "add") for k, d, a in events if k is not None and d is not None and a in ("add", "remove") and own(k) == key and d <= day]
        if past and max(past)[1]:
            found.append((-len(key), key, max(past)[0]))
    return min(found)[1:] if found else None


def test_random_lists_match_brute_force(spark):
    rng = random.Random(5)
    hosts = ["a.com", "x.a.com", "y.x.a.com", "b.org", "aa.com"]
    day = lambda: date(2024, 1, 1) + timedelta(rng.randrange(300))
    events = [(rng.choice(hosts) + rng.choice(["", "", "/p", "/p/q", "/P", "/p/Q/"]), day(), rng.choice(["add", "remove", "other", None])) for _ in range(60)]
    events += [(None, day(), "add"), ("a.com", None, "add"), ("b.org", date(2024, 5, 5), "add"), ("b.org", date(2024, 5, 5), "remove"), ("B.org/", date(2024, 5, 5), "add")]
    urls = [f"{rng.choice(['http', 'HTTPS'])}://{rng.choice(['', 'u:p@'])}{rng.choice(hosts)}{rng.choice(['', ':80', '.'])}{rng.choice(['', '/', '/p', '/p/q/r?x=/y', '/pp#z', '?q'])}" for _ in range(80)]
    captures = [(i, u, day(), "own") for i, u in enumerate(urls)] + [(None, None, day(), "x"), (7, "http://a.com/p", None, "x"), (8, "no url", day(), "x"), (9, "", day(), "x"), (9, "", day(), "x"), (10, "http:///p", day(), "x")]
    c = spark.createDataFrame(captures, "page_id bigint, url string, fetched date, key string")
    e = spark.createDataFrame(events, urlfilter.LIST_SCHEMA)
    got = sorted(((r.page_id, r.fetched, r.blocked, r.entry, r.active_since) for r in urlfilter.url_filter(c, e).collect()), key=str)
    want = sorted(((i, d, (b := brute(u, d, events)) is not None, b and b[0], b and b[1]) for i, u, d, _ in captures), key=str)
    assert got == want
    assert any(w[2] for w in want)
    assert urlfilter.url_filter(c.limit(0), e).count() == 0
    assert urlfilter.url_filter(c, e.limit(0)).filter("blocked").count() == 0


def test_paths_keep_their_case(spark):
    c = spark.createDataFrame([(1, "http://Example.com/Ads/x", date(2024, 2, 1)), (2, "http://example.com/ads/x", date(2024, 2, 1))], "page_id bigint, url string, fetched date")
    e = spark.createDataFrame([("EXAMPLE.com/Ads", date(2024, 1, 1), "add")], urlfilter.LIST_SCHEMA)
    assert sorted((r.page_id, r.blocked, r.entry) for r in urlfilter.url_filter(c, e).collect()) == [(1, True, "example.com/Ads"), (2, False, None)]
