"""URL rules by token index against every rule on every URL."""

import random
import re

from pnlbook.llm import urlrules

SEP = r"(?:[^A-Za-z0-9_.%-]|\Z)"
FOLD = str.maketrans(urlrules.UPPER, urlrules.LOWER)


def parts(url):
    at = (url or "").find("://")
    if at < 0:
        return "", "", "", url or ""
    rest = url[at + 3:]
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
    site = host.translate(FOLD) + rest[len(host):]
    return host.translate(FOLD), path, site, url[:at + 3] + site


def fits(rule, url):
    """A rule on a URL, character by character."""
    _, _, site, full = parts(url)
    body = rule[2:] if rule.startswith("||") else rule[1:] if rule.startswith("|") else rule
    end = rule.endswith("|")
    body = body[:-1] if end else body
    rx = "".join(".*" if c == "*" else SEP if c == "^" else re.escape(c) for c in body) + (r"\Z" if end else "")
    head = r"(?:[^/?#]*\.)?" if rule.startswith("||") else ""
    run = re.match if rule.startswith("|") else re.search
    return bool(run(head + rx, site if rule.startswith("||") else full, re.S))


def judged(url, rules):
    """(rule, pattern, verdict) with every rule tried."""
    hit = [] if url is None else [(r, a) for r, a in rules if fits(r, url)]
    sites = [(len(r), a == "block", r, a) for r, a in hit if re.fullmatch(r"\|\|[^/*^|]+/[^*^|]*", r)]
    if sites:
        top = max(x[:2] for x in sites)
        r, a = min((x[2], x[3]) for x in sites if x[:2] == top)
        return r[2:], None, a
    if not hit:
        return None, None, "allow"
    top = min(a for _, a in hit)                # allow before block
    return None, min(r for r, a in hit if a == top), top


def test_rules_against_every_rule(spark):
    rng = random.Random(11)
    bits = ["a", "b", "org", "com", "en", "1", "12", "x", "ads-track", "html", "page", "Fr", "\u00e9"]
    word = lambda: rng.choice(bits)
    urls = [f"{rng.choice(['http', 'HTTPS', ''])}://{'.'.join(word() for _ in range(rng.randint(1, 3)))}{rng.choice(['', '/', ':80/'])}"
            f"{'/'.join(word() for _ in range(rng.randint(0, 3)))}{rng.choice(['', '?', '?page=2', '#top', '/?a=://b.org/en'])}" for _ in range(1200)]
    rules = {}
    for _ in range(120):
        body = "".join(rng.choice([word(), word(), ".", "/", "*", "^", "=", "?"]) for _ in range(rng.randint(1, 6)))
        rule = rng.choice(["||", "|", "", ""]) + body + rng.choice(["", "", "|"])
        if rule.strip("|"):
            rules[rule] = rng.choice(["allow", "block"])
    for h in ("org", "com", "a.org", "b.com"):
        for p in ("/", "/en", "/en/", "/en/1", "/x/", "/Fr"):
            rules[f"||{h}{p}"] = rng.choice(["allow", "block"])
    odd = [None, "", "no scheme/en/", "://", "://org/", "x://ORG/en/12", "http://" + "a." * 20 + "org/en/1" + "/b" * 20, "http://a\nb.org/en/"]
    rows = [(k, u, "clash", "clash") for k, u in enumerate(urls + odd)] + [(None, urls[0], "", ""), (5, urls[5], "", "")]
    pages = spark.createDataFrame(rows, "page_id LONG, url STRING, host STRING, token STRING")
    got = urlrules.judge(pages, urlrules.rule_table(spark, rules.items()))
    assert got.columns == ["page_id", "host", "path", "rule", "pattern", "verdict"]
    want = [(r[0], *parts(r[1])[:2], *judged(r[1], list(rules.items()))) for r in rows]
    key = lambda r: tuple((x is None, x or "") if not isinstance(x, int) else (False, str(x)) for x in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)
    assert {v for *_, v in want} == {"allow", "block"} and sum(r is not None for *_, r, _, _ in want) > 50
    assert urlrules.judge(pages.limit(0), urlrules.rule_table(spark, rules.items())).count() == 0
    assert {r.verdict for r in urlrules.judge(pages, urlrules.rule_table(spark, [])).collect()} == {"allow"}


def test_very_long_url(spark):
    long = "http://" + "a." * 50_000 + "org/en/1" + "/b" * 500_000
    pages = spark.createDataFrame([(1, long), (2, None)], "page_id LONG, url STRING")
    got = {r.page_id: r for r in urlrules.judge(pages, urlrules.rule_table(spark, [("||org/", "allow"), ("||org/en/1", "block"), ("||b.org/", "allow")])).collect()}
    assert got[1].rule == "org/en/1" and got[1].verdict == "block" and len(got[1].path) == 1_000_005 and got[2].verdict == "allow"


def test_rarest_token_and_shuffled_rules(spark):
    rules = urlrules.compiled(urlrules.rule_table(spark, [("||common.rare/", "block"), ("*x*", "block"), ("/en/1", "allow")]))
    urls = spark.createDataFrame([("http://common.a/",), ("http://common.b/",), ("http://common.rare/en/12",)], "url STRING")
    index = {r.rule: r.token for r in urlrules.indexed(rules, urls).collect()}
    assert index == {"||common.rare/": "rare", "*x*": "", "/en/1": "en"}
    spark.conf.set("pnlbook.broadcast.maxRows", "0")            # beyond the bound: joined by shuffle, same hits
    try:
        hits = urlrules.matches(urls, urlrules.indexed(rules, urls)).collect()
    finally:
        spark.conf.unset("pnlbook.broadcast.maxRows")
    assert sorted((r.url, r.rule) for r in hits) == [("http://common.rare/en/12", "/en/1"), ("http://common.rare/en/12", "||common.rare/")]


def test_no_python_worker(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id LONG, url STRING")
    plan = urlrules.judge(pages, urlrules.rule_table(spark, urlrules.RULES))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan
