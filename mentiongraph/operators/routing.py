"""Routing change events to subscribers.

A subscriber has topic terms (F5: three characters or more, in lower case, without white space) and a set
of entity subscriptions. An event goes to a subscriber when some term is a substring of the event's
haystack (article id and changed entity ids, F6) and some changed entity is subscribed; a subscriber
without terms, or without subscriptions, passes that half.

A term can only lie inside one token of an id. Ids repeat from event to event, so matching runs over the
tokens of the distinct ones: an index of their substrings of a few lengths, where each term looks up its rarest
substring of the greatest such length that it holds, and the tokens found are checked for the whole term. That gives
the ids of each subscriber's topic, as its subscriptions are ids. Of a subscriber with both kinds, only the kind whose
ids come up in fewer events is spread over events; the ids of those events are then looked up in the other kind.
Subscribers without any filter get every event; they are named once (``open_clients``), not paired with each event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

# lengths of the index's substrings, each at most half as long again as the one before
GRAMS = (3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128)


def _grams(text: Column, size: Column) -> Column:
    """The distinct substrings of ``size`` characters; none of a shorter text."""
    n = F.char_length(text)
    places = F.when(n >= size, F.sequence(F.lit(1), n - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, size)))


def matching_tokens(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, token): the distinct tokens that contain each of the distinct terms of three characters or more."""
    size = F.greatest(*[F.when(F.char_length("term") >= g, F.lit(g)) for g in GRAMS])
    sized = terms.select("term", size.alias("size")).filter("size is not null")
    sizes = sorted(r["size"] for r in sized.select("size").distinct().collect())  # some of GRAMS
    wanted = sized.select("term", F.explode(_grams(F.col("term"), F.col("size"))).alias("gram"))
    lengths = tokens.select("token", F.explode(F.array(*map(F.lit, sizes)).cast("array<int>")).alias("size"))
    index = lengths.select("token", F.explode(_grams(F.col("token"), F.col("size"))).alias("gram"))
    often = index.join(wanted.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    # a term with a substring that no token has is in no token
    rarest = wanted.join(often, "gram", "left").groupBy("term").agg(F.min(F.struct("df", "gram")).alias("r")) \
        .filter("r.df is not null").select("term", F.col("r.gram").alias("gram"))
    return index.join(rarest, "gram").filter(F.contains("token", "term")).select("term", "token")


def _numbered(names: DataFrame, out: str) -> DataFrame:
    """For a table that is written at once: later reads find the numbers given then."""
    return names.withColumn(out, F.monotonically_increasing_id())


def route(event_entities: DataFrame, client_terms: DataFrame, client_subs: DataFrame, clients: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """J8 -> (client_id, event_id) of the subscribers with a filter; see ``open_clients`` for the others.

    event_entities: (event_id, article_id, entity_id); client_terms: (client_id, term);
    client_subs: (client_id, entity); clients: (client_id). The steps become tables of ``scratch``, each of which frees the
    shuffle files that it took.
    """
    scratch = scratch or Scratch(event_entities.sparkSession, free_shuffles=True)
    mat = scratch.write
    articles = event_entities.select("event_id", F.col("article_id").cast("string").alias("id")).distinct()
    named = event_entities.select("event_id", F.col("entity_id").alias("id"), F.lit(True).alias("entity")).unionByName(articles.withColumn("entity", F.lit(False)))
    ids = mat("route-ids", _numbered(named.filter("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n")), "i"))
    events = mat("route-events", named.join(ids, "id").select("event_id", "i", "entity"))
    kinds = (clients.select("client_id").distinct()
             .join(client_terms.select("client_id", F.lit(True).alias("by_topic")).distinct(), "client_id", "left")
             .join(client_subs.select("client_id", F.lit(True).alias("by_entity")).distinct(), "client_id", "left"))
    kinds = mat("route-clients", _numbered(kinds.fillna(False), "c"))
    who = kinds.select("client_id", "c")

    words = mat("route-tokens", ids.select("i", "n", F.explode(F.array_distinct(F.split(F.lower("id"), r"\s+"))).alias("token")))
    matches = mat("route-matches", matching_tokens(words.select("token").distinct(), client_terms.select("term").distinct()))
    topic = client_terms.join(who, "client_id").select("c", "term").distinct().join(matches, "term").select("c", "token").distinct()
    topic = mat("route-topic", topic.join(words, "token").select("c", "i", "n").distinct())
    subs = client_subs.join(who, "client_id").select("c", F.col("entity").alias("id")).distinct().join(ids, "id").select("c", "i", "n")
    subs = mat("route-subs", subs)
    scratch.drop("route-ids", "route-matches")

    def spread(half: DataFrame, out: str) -> DataFrame:
        return half.groupBy("c").agg(F.sum("n").alias(out))

    # a subscriber with both kinds but without any id of one of them gets nothing
    both = kinds.filter("by_topic and by_entity").select("c").join(spread(topic, "_t"), "c").join(spread(subs, "_s"), "c")
    plan = both.select("c", (F.col("_t") <= F.col("_s")).alias("topic_first"), F.lit(True).alias("check")).unionByName(
        kinds.filter("by_topic <> by_entity").select("c", F.col("by_topic").alias("topic_first"), F.lit(False).alias("check")))
    plan = mat("route-plan", plan)
    first, then = (topic.join(plan.filter(t), "c").unionByName(subs.join(plan.filter(s), "c"))
                   for t, s in (("topic_first", "not topic_first"), ("check and not topic_first", "check and topic_first")))
    met = (first.select("c", "i", "topic_first", "check").join(events, "i").filter("entity or topic_first")
           .select("c", "event_id", "topic_first", "check").distinct())
    met = mat("route-met", met)
    checked = (met.filter("check").join(events, "event_id").filter("entity or not topic_first").select("c", "event_id", "i")
               .join(then.select("c", "i"), ["c", "i"], "left_semi").select("c", "event_id").distinct())
    passed = met.filter("not check").select("c", "event_id").unionByName(checked)
    found = mat("route-found", passed.join(who, "c").select("client_id", "event_id"))
    scratch.keep("route-tokens", "route-found")
    return found


def open_clients(client_terms: DataFrame, client_subs: DataFrame, clients: DataFrame) -> DataFrame:
    """(client_id) of the subscribers without terms and without subscriptions: every event goes to them."""
    filtered = client_terms.select("client_id").unionByName(client_subs.select("client_id")).distinct()
    return clients.select("client_id").distinct().join(filtered, "client_id", "left_anti")


def deliveries(routed: DataFrame, open_to_all: DataFrame, events: DataFrame) -> DataFrame:
    """(client_id, delivered): events per subscriber; one that is open to all gets the number of distinct events."""
    every = events.select("event_id").distinct().agg(F.count(F.lit(1)).alias("delivered"))
    whole = open_to_all.select("client_id", every.select("delivered").scalar().alias("delivered"))
    return routed.groupBy("client_id").agg(F.count(F.lit(1)).alias("delivered")).unionByName(whole)
