"""Routing against fixture 15 and brute force."""

import random

from mentiongraph.operators import routing as rt


def test_route_fixture_15(spark):
    ev = spark.createDataFrame([(1, "a1", "Bob"), (2, "a2", "Alice")], "event_id long, article_id string, entity_id string")
    clients = spark.createDataFrame([("c1",), ("c2",)], "client_id string")
    terms = spark.createDataFrame([], "client_id string, term string")
    subs = spark.createDataFrame([("c1", "Alice")], "client_id string, entity string")
    got = sorted((r.client_id, r.event_id) for r in rt.route(ev, terms, subs, clients).collect())
    assert got == [("c1", 2)] and [r.client_id for r in rt.open_clients(terms, subs, clients).collect()] == ["c2"]


def test_route_topic_substring(spark):
    ev = spark.createDataFrame([(1, "x1", "part-42"), (2, "x2", "part-7"), (3, "x3", "part-420")],
                               "event_id long, article_id string, entity_id string")
    clients = spark.createDataFrame([("c",)], "client_id string")
    terms = spark.createDataFrame([("c", "part-42")], "client_id string, term string")
    subs = spark.createDataFrame([], "client_id string, entity string")
    got = sorted(r.event_id for r in rt.route(ev, terms, subs, clients).collect())
    assert got == [1, 3]


def test_route_equals_brute_force(spark):
    rnd = random.Random(11)
    names = ["Anna Bell", "bell", "BELLA", "ab", "Carl-Bell", "x", "Ann", "Ärgernis", "part-42", "42"]
    events = [(e, f"art-{e % 5} y", rnd.choice(names)) for e in range(12) for _ in range(rnd.randint(1, 3))]
    clients = [f"c{k}" for k in range(14)]
    terms = [(c, rnd.choice(["bell", "ann", "art-3", "ella", "zzz", "rt-", "ärg", "bellbell", "42x"])) for c in clients[:9] for _ in range(rnd.randint(0, 2))]
    subs = [(c, rnd.choice([*names, "nobody"])) for c in clients[4:12] for _ in range(rnd.randint(0, 2))]
    want, free = set(), set()
    for c in clients:
        t, s = [x for k, x in terms if k == c], [x for k, x in subs if k == c]
        if not t and not s:
            free.add(c)
            continue
        for e in {r[0] for r in events}:
            ids = [r[2] for r in events if r[0] == e]
            hay = " ".join([f"art-{e % 5} y", *ids]).lower()
            if (not t or any(x in hay for x in t)) and (not s or any(i in s for i in ids)):
                want.add((c, e))
    ev = spark.createDataFrame(events, "event_id long, article_id string, entity_id string")
    args = (spark.createDataFrame(terms, "client_id string, term string"), spark.createDataFrame(subs, "client_id string, entity string"),
            spark.createDataFrame([(c,) for c in clients], "client_id string"))
    got = rt.route(ev, *args)
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
    assert {r.client_id for r in rt.open_clients(*args).collect()} == free and free
    totals = {r.client_id: r.delivered for r in rt.deliveries(got, rt.open_clients(*args), ev).collect()}
    assert totals == {c: 12 for c in free} | {c: sum(k == c for k, _ in want) for c in {k for k, _ in want}}


def _most_rows(spark, df) -> int:
    """The most rows that any operator of the plan puts out."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        run = df.sparkSession._jvm.org.apache.spark.sql.classic.Dataset.ofRows(df._jdf.sparkSession(), df._jdf.queryExecution().analyzed()).queryExecution()
        run.toRdd().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")

    def walk(plan):
        own = plan.metrics().apply("numOutputRows").value() if plan.metrics().contains("numOutputRows") else 0
        return max([own, *(walk(plan.children().apply(i)) for i in range(plan.children().size()))])

    return walk(run.executedPlan())


def test_long_terms_meet_few_tokens(spark, monkeypatch):
    """Every trigram of these words lies in most of them; a term of ten letters is compared with the few that share eight."""
    words = ["".join("ab"[k >> i & 1] for i in range(10)) for k in range(1024)]
    tokens, terms = spark.createDataFrame([(w,) for w in words], "token string"), spark.createDataFrame([(w,) for w in [*words, "abbabbabbabba", "ab"]], "term string")
    found = rt.matching_tokens(tokens, terms)
    assert sorted(map(tuple, found.collect())) == sorted((w, w) for w in words)
    monkeypatch.setattr(rt.F, "contains", lambda *_: rt.F.lit(True))  # the pairs that are compared
    assert rt.matching_tokens(tokens, terms).count() < 20_000


def test_only_the_smaller_half_is_spread_over_events(spark, monkeypatch):
    """Forty subscribers take every entity, each with a term that two events have: no step makes a row for each subscriber and event."""
    names = [f"name-{k}" for k in range(30)]
    events = [(e, f"art-{e}", n) for e in range(200) for n in names[e % 5::6]] + [(e, f"art-{e}", f"rare-{e // 2}x") for e in range(80)]
    clients = [f"c{k}" for k in range(40)]
    ev = spark.createDataFrame(events, "event_id long, article_id string, entity_id string")
    args = (spark.createDataFrame([(c, f"re-{k}x") for k, c in enumerate(clients)], "client_id string, term string"),
            spark.createDataFrame([(c, n) for c in clients for n in names], "client_id string, entity string"),
            spark.createDataFrame([(c,) for c in clients], "client_id string"))
    rows, write = [], rt.Scratch.write

    def counted(self, name, df, **how):
        rows.append(_most_rows(spark, df))
        return write(self, name, df, **how)

    monkeypatch.setattr(rt.Scratch, "write", counted)
    got = rt.route(ev, *args)
    rows.append(_most_rows(spark, got))
    assert sorted(map(tuple, got.collect())) == sorted((f"c{k}", e) for k in range(40) for e in (2 * k, 2 * k + 1))
    assert max(rows) < 5 * 200 * 40 / 4
