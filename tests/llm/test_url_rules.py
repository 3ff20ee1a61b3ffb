"""URL verdicts against a plain search of all rules."""

from __future__ import annotations

import random

import pytest

from folio.llm import url_rules

RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("COM", "/fr/", "allow"), ("com", "/de/", "block"),
    ("b.example.org", None, "block"), ("x.org", "/a", "allow"), ("x.org", "/a", "block"), ("net", "", "block"), ("a.net", "/q", "allow"),
    (None, "/", "block"), ("", "/", "block"), ("bad/host", "/", "block"), ("org", "/k", None), ("org", "no-slash", "block"), ("localhost:80", "/", "block"),
]
URLS = [
    None, "", "no scheme", "http://", "http:///path", "https://EXAMPLE.org/es/1", "https://www.example.org/es/", "https://notexample.org/es/", "http://example.org/en/148.html",
    "http://example.org/en/2", "http://example.org/ES/", "http://org", "http://org/", "http://org?x=/", "http://a.org#/", "http://a.com/fr/x?y#z", "http://a.com/de/", "http://com.evil/de/",
    "http://b.example.org", "http://b.example.org/es/", "http://x.org/abc", "ftp://u:p@a.net/q/1", "http://net", "http://.net/", "http://net./", "http://a.net/Q", "http://localhost:80/x",
    "http://orgno-slash", "x://y://a.org/z", "http://ÜÄ.org/é", "http://a\nb.org/c\nd", "http://" + "a." * 3000 + "org/" + "p/" * 5000, "http://a.org/" + "é" * 4000, "http://a.org/\x00",
]


def plain(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url[url.index("://") + 3 :]
        cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host, rest = rest[:cut], rest[cut:]
        path = rest[: next((i for i, c in enumerate(rest) if c in "?#"), len(rest))]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = []
    for h, p, verdict in rules:
        h, p = (h or "").lower(), p or ""
        if h and "/" not in h and verdict and (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(h + p), len(h), verdict == "block", h + p, verdict))
    best = max(fits) if fits else (0, 0, 0, None, "allow")
    return host, path, best[3], best[4]


def judged(spark, rows, rules):
    table = spark.createDataFrame(rows, "page_id long, url string, rule string, digest string, prefix string, best string")
    given = spark.createDataFrame(rules, "host string, path string, verdict string")
    return sorted([tuple(r) for r in url_rules.judge(table, given).collect()], key=repr)


@pytest.mark.parametrize("digits", [8, 1])
def test_every_kind_of_address(spark, monkeypatch, digits):
    monkeypatch.setattr(url_rules, "PREFIX_DIGITS", digits)  # short prefixes collide: only full digests may decide
    rows = [(i, u, "r", "d", "p", "b") for i, u in enumerate(URLS)] + [(None, URLS[5], *"rdpb"), (None, URLS[5], *"rdpb"), (3, None, *"rdpb")]
    assert judged(spark, rows, RULES) == sorted([(r[0], *plain(r[1], RULES)) for r in rows], key=repr)


def test_many_rules(spark):
    draw = random.Random(8)

    def some(n):
        return "".join(draw.choice("ab") for _ in range(draw.randrange(1, n)))

    rules = [(".".join(some(3) for _ in range(draw.randrange(1, 4))), "/" + some(4) * draw.randrange(2), draw.choice(("allow", "block"))) for _ in range(400)]
    rows = [(i, "http://" + ".".join(some(3) for _ in range(draw.randrange(1, 5))) + "/" + some(6) + "/" + some(3), *"rdpb") for i in range(300)]
    assert judged(spark, rows, rules) == sorted([(r[0], *plain(r[1], rules)) for r in rows], key=repr)


def test_no_rows_and_no_rules(spark):
    assert judged(spark, [], RULES) == []
    assert judged(spark, [(1, "http://a.org/x", *"rdpb")], []) == [(1, "a.org", "/x", None, "allow")]
