import numpy as np

from palaver.llm import url_filter as op


def brute_rule(host, path, rules):
    fit = []
    for i, (verdict, rule) in enumerate(rules):
        name, slash, prefix = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith(slash + prefix):
            fit.append((-len(rule), i, rule, verdict))
    return min(fit)[2:] if fit else (None, None)


URLS = [
    "https://www.Example.COM/en/1?x#y", "http://a.example.com/en/", "http://example.com/enx", "http://xexample.com/en/", "http://example.com", "http://com/", "http://a.net/es/1",
    "http://net/fr/", "http://a.net/fr", "http://ww.www.example.com/en/z", "http://a.org/es/?a=http://b.com/", "nothing", "", None, "://", "http://user:1@a.com:80/x", "http://É.com/é?",
    "https://one-two.example.org/es/750?page=2&ref=x", "https://three.example.net/en/196#top", "http://x.com\n/en/",
]


def test_rules_and_parts(spark, monkeypatch):
    rules = op.RULES + [("block", "com/en/"), ("allow", "com/en/"), ("block", "com/x"), ("allow", "org")]
    for at_once in (2, 500):
        monkeypatch.setattr(op, "RULES_AT_ONCE", at_once)
        df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)] + [(0, URLS[0], "h"), (None, URLS[1], "h")], "page_id long, url string, host string")
        judges = op.train_labelled(op.label_by_rules(df, rules))
        got = op.url_filter(df, rules=rules, judges=judges).collect()
        assert len(got) == len(URLS) + 2
        for r in got:
            u = URLS[r.page_id if r.page_id is not None else 1]
            assert (r.host, r.path) == op.split_url(u)
            rule, verdict = brute_rule(r.host, r.path, rules)
            assert r.rule == rule and (verdict or ("block" if r.odds > judges.threshold else "allow")) == r.verdict
    assert op.url_filter(df.limit(0)).collect() == []
    assert {r.rule for r in op.url_filter(df, rules=[]).collect()} == {None}


def made_urls(seed, n=2000):
    """Labelled urls of several hundred hosts: those to block have long hosts of mixed digits, deep paths and parameters, or a zone of their own."""
    rnd = np.random.Generator(np.random.PCG64(seed))
    letters, digits = list("bcdfglmnprstaeiou"), list("0123456789")
    word = lambda v, lo, hi: "".join(rnd.choice(v) for _ in range(int(rnd.integers(lo, hi))))
    hosts = []
    for i in range(400):
        kind = i % 4
        name = word(letters + digits, 14, 24) if kind == 1 else word(letters, 5, 12)
        hosts.append((f"{name}.{'zip' if kind == 3 else str(rnd.choice(['com', 'org', 'de']))}", kind % 2))
    out = []
    for _ in range(n):
        host, bad = hosts[int(rnd.integers(len(hosts)))]
        path = "/".join(word(letters, 3, 8) for _ in range(int(rnd.integers(1, 4))))
        out.append((f"https://{host}/{path}{rnd.choice(['', '?a=1', '.html'])}", bad))
    return out


def test_hosts_are_judged_by_other_hosts():
    rows = made_urls(1)
    judges = op.train_judges(rows)
    r = judges.report
    assert r["accuracy"] > 0.8 and r["blocked_caught"] > 0.6 and r["allowed_blocked"] < 0.006 and r["hosts"] > 350, r
    again = made_urls(2)  # hosts that no tree has seen
    y = np.array([b for _, b in again], bool)
    odds = judges.odds([u for u, _ in again])
    assert ((odds > 0.5) == y).mean() > 0.9 and (odds > judges.threshold)[~y].mean() < 0.03 and (odds > judges.threshold)[y].mean() > 0.6
    # labels that do not go with the hosts' letters are learnt by none: a host's own label never reaches its judge
    noise = op.train_judges([(u, int(op.zlib.crc32(op.split_url(u)[0].encode()) // 7 % 2)) for u, _ in rows if ".zip" not in u])
    assert noise.report["blocked_caught"] < 0.1


def test_rules_label_where_no_table_does(spark):
    """Rules block one language of some hosts; other hosts' urls of that kind are found, none of another kind."""
    rows = [(i, f"https://h{i * i % 97}x{i % 7}.example.{'com' if i % 2 else 'org'}/{'en' if i % 3 else 'de'}/{i}") for i in range(1200)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    # of the hosts under .org with /en/, 3 in 4 are named by a rule
    named = sorted({u.split("://")[1].split("/")[0] for _, u in rows if ".org" in u})
    rules = [("block", f"{h}/en/") for i, h in enumerate(named) if i % 4]
    labelled = op.label_by_rules(df, rules)
    assert {r.blocked for r in labelled.collect()} == {0, 1} and labelled.count() == 1200
    got = op.url_filter(df, rules=rules).collect()
    assert all(r.verdict == "allow" for r in got if ".com" in r.host or r.path.startswith("/de/"))
    free = [r for r in got if r.rule is None and ".org" in r.host and r.path.startswith("/en/")]
    blocked = {r.url for r in labelled.collect() if r.blocked}
    assert len(free) > 20 and len(blocked) > 200
    assert np.mean([r.odds for r in free]) > 5 * np.mean([r.odds for r in got if ".com" in r.host])


def test_trees_as_walked():
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(500, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    trees = op.boost(x, y)
    assert np.mean((trees.margin(x) > 0) == y) > 0.9
    for row, m in zip(x[:20], trees.margin(x[:20])):
        total = trees.base
        for f, s, v in zip(trees.feature, trees.split, trees.value):
            at = 0
            while at < 2**op.DEPTH - 1:
                at = 2 * at + 1 + (row[f[at]] > s[at])
            total += v[at - (2**op.DEPTH - 1)]
        assert abs(total - m) < 1e-9


def test_labelled_table(spark):
    rows = [*made_urls(3, 900), (None, 1), ("http://a.com", None), ("http://a.com", 7)]
    labelled = spark.createDataFrame(rows * 2, "url string, blocked int")
    assert 450 < op.train_labelled(labelled, 500).report["labelled"] <= 500 and op.train_labelled(labelled).report["labelled"] == len(set(rows[:900]))
    few = op.train_labelled(labelled, per_host=2).report
    assert few["hosts"] < few["labelled"] <= 2 * few["hosts"]
    pages = spark.createDataFrame([(1, "http://gardens.zip/abc/fed", 5, "x"), (2, "http://garden.de/a/b", 6, None), (3, None, 7, None)], "page_id long, url string, odds int, `a.b` string")
    got = {r.page_id: r.verdict for r in op.url_filter(pages, labelled=labelled).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow"}
    # without labels of both kinds nothing is blocked
    one = spark.createDataFrame([("http://a.com/", 1)], "url string, blocked int")
    assert {(r.verdict, r.odds) for r in op.url_filter(pages, labelled=one).collect()} == {("allow", 0.0)}
