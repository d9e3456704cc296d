"""Mined URL rules do not depend on the size of the crawl: bad hosts and pairs of small share, by brute force."""

from itertools import combinations

from cityflux.llm import urls


def test_bad_hosts_of_small_share_are_blocked(spark):
    rows = [(f"https://site{i % 3000}.org/p{i % 7}/x{i % 11}", i % 10 == 0) for i in range(30_000)]
    rows += [(f"https://bad.org/p{i % 7}/a{i}", i % 5 > 0) for i in range(40)]
    rows += [(f"https://half.org/{'ads' if i % 2 else 'news'}/b{i}", i % 2 == 1) for i in range(80)]
    rows += [(f"https://shop{i}.org/ads/c{i}", False) for i in range(80)]
    rows += [(f"https://few.org/d{i}", True) for i in range(24)]
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    found = {tuple(r["rule"]): r["confidence"] for r in urls.mine(labelled).collect()}
    count = {}
    for url, bad in rows:
        host, *path = url.removeprefix("https://").split("/")
        held = sorted({"scheme=https", *(f"host={x}" for x in host.split(".")), *(f"path={x}" for x in path)})
        for size in (1, 2, 3):
            for part in combinations(held, size):
                n = count.setdefault(part, [0, 0])
                n[0] += bad
                n[1] += 1
    fine = {p: b / n for p, (b, n) in count.items() if b >= urls.PAGES and b >= urls.CONFIDENCE * n}
    least = {p: c for p, c in fine.items() if not any(q in fine for size in range(1, len(p)) for q in combinations(p, size))}
    assert found == least and ("host=bad",) in least and ("host=half", "path=ads") in least and ("host=few",) not in least
