"""The library's queries on the test tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import hashes, labels, scoring, text
from lodestone.operators import aggregates as agg
from lodestone.operators import filters, layout, matching, ranking, state
from lodestone.operators.shared import spread, written
from lodestone.plans import intent, memory, study

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Every age is counted from here: queries are never run against the clock.
NOW = "TIMESTAMP '2024-02-01 00:00:00'"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Facts are embeddings whose other fields follow from their number; an account holds 400 of them, which is its capacity.
FACTS_SQL = """facts AS (SELECT vec_id AS id, (vec_id // 400)::VARCHAR AS account_id, 'k' || label AS kind, 'fact ' || vec_id AS text, embedding::DOUBLE[] AS e,
    (vec_id % 10) / 10.0::DOUBLE AS importance, CASE WHEN vec_id % 11 = 3 THEN 'superseded' ELSE 'active' END AS status, vec_id % 8 AS use_count, (vec_id % 90)::DOUBLE AS age FROM embeddings)"""
# The same where an account is a seventh of all facts, which grows with the table: for the joins of facts with those of their account.
SEVENTHS_SQL = FACTS_SQL.replace("vec_id // 400", "vec_id % 7")
COS_SQL = "list_dot_product({0}, {1}) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})))"
SCORED_SQL = f"""{FACTS_SQL}, q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0),
    parts AS (SELECT id, kind, text, greatest(0, least(1, {COS_SQL.format("e", "v")})) AS semantic, exp(-age / 21) AS recency, importance, least(use_count, 5) / 5.0::DOUBLE AS usage
              FROM facts, q WHERE status = 'active'),
    scored AS (SELECT id, kind, text, round(semantic, 4) AS semantic, round(recency, 4) AS recency, round(importance, 4) AS importance, round(usage, 4) AS usage,
               round(0.6::DOUBLE * semantic + 0.15::DOUBLE * recency + 0.2::DOUBLE * importance + 0.05::DOUBLE * usage, 4) AS score FROM parts)"""


def facts(spark: SparkSession, sf_dir: str, sevenths: bool = False) -> DataFrame:
    n = F.col("vec_id")
    account = n % 7 if sevenths else F.floor(n / 400)
    return table(spark, sf_dir, "embeddings").select(
        n.alias("id"), account.cast("string").alias("account_id"), F.concat(F.lit("k"), F.col("label").cast("string")).alias("kind"), F.concat(F.lit("fact "), n.cast("string")).alias("text"), "embedding",
        ((n % 10) / 10.0).alias("importance"), F.when(n % 11 == 3, "superseded").otherwise("active").alias("status"), (n % 8).alias("use_count"), F.expr(f"{NOW} - make_dt_interval(cast(vec_id % 90 as int))").alias("updated_at"),
    )


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The query vector: one row by key; without that row, a vector like no other."""
    found = filters.by_key(table(spark, sf_dir, "embeddings"), vec_id=0).first()
    return found["embedding"] if found else [0.0]


@query(f"WITH {SCORED_SQL} SELECT id, kind, text, score, semantic, recency, importance, usage FROM scored WHERE score >= 0.3 ORDER BY score DESC, id LIMIT 5")
def q1_retrieve(spark, sf_dir):
    """Q1: P1 P17 J2 F1-F6 P7 T1."""
    return memory.retrieve(facts(spark, sf_dir), first_vector(spark, sf_dir), F.expr(NOW), k=5, min_score=0.3)


TURNS_SQL = f"""{FACTS_SQL}, pairs AS (SELECT q.vec_id AS turn_id, f.*, greatest(0, least(1, coalesce({COS_SQL.format("f.e", "q.v")}, 0))) AS semantic, exp(-age / 21) AS recency, least(use_count, 5) / 5.0::DOUBLE AS usage
        FROM (SELECT vec_id, (vec_id // 400)::VARCHAR AS account_id, embedding::DOUBLE[] AS v FROM embeddings) q JOIN facts f USING (account_id) WHERE status = 'active'),
    scored AS (SELECT turn_id, id, kind, text, round(semantic, 4) AS semantic, round(recency, 4) AS recency, round(importance, 4) AS importance, round(usage, 4) AS usage,
               round(0.6::DOUBLE * semantic + 0.15::DOUBLE * recency + 0.2::DOUBLE * importance + 0.05::DOUBLE * usage, 4) AS score FROM pairs)"""


@query(f"""WITH {TURNS_SQL} SELECT turn_id, rank, id, kind, text, score, semantic, recency, importance, usage
    FROM (SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY score DESC, id)::INTEGER AS rank FROM scored WHERE score >= 0.3) WHERE rank <= 5""")
def j2_turns(spark, sf_dir):
    """J2 Q1 for many turns: every vector is asked for in its account."""
    turns = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("turn_id"), F.floor(F.col("vec_id") / 400).cast("string").alias("account_id"), F.col("embedding").alias("query"))
    return memory.retrieve_turns(facts(spark, sf_dir), turns, F.expr(NOW), k=5, min_score=0.3)


@query(f"""WITH {SCORED_SQL}, best AS (SELECT * FROM scored WHERE score >= 0.3 ORDER BY score DESC, id LIMIT 20)
    SELECT id, kind, text, score, semantic, recency, importance, usage FROM best WHERE id % 2 = 1""")
def q1_retrieve_excluding(spark, sf_dir):
    """Exclusion after the cut."""
    f = facts(spark, sf_dir)
    return memory.retrieve(f, first_vector(spark, sf_dir), F.expr(NOW), k=20, min_score=0.3, exclude=f.where("id % 2 = 0").select("id"))


@query(f"WITH {FACTS_SQL} SELECT id, kind, text, importance FROM facts WHERE status = 'active' AND kind IN ('k1', 'k2') ORDER BY importance DESC, age, id LIMIT 10")
def q2_persona(spark, sf_dir):
    """Q2: P3 T2."""
    return memory.persona(facts(spark, sf_dir), n=10, kinds=("k1", "k2")).select("id", "kind", "text", "importance")


@query(f"""WITH {SCORED_SQL}, p AS (SELECT id, kind, text FROM facts WHERE status = 'active' AND kind IN ('k1', 'k2') ORDER BY importance DESC, age, id LIMIT 3),
    r AS (SELECT * FROM scored WHERE score >= 0.3 ORDER BY score DESC, id LIMIT 10)
    SELECT id, kind, text, 0 AS slot FROM p UNION ALL SELECT id, kind, text, 1 FROM r WHERE id NOT IN (SELECT id FROM p)""")
def q3_for_turn(spark, sf_dir):
    """Q3: J6."""
    return memory.for_turn(facts(spark, sf_dir), first_vector(spark, sf_dir), F.expr(NOW), n=3, k=10, kinds=("k1", "k2"))


@query(f"WITH {FACTS_SQL} SELECT kind, count(*) AS n FROM facts WHERE status = 'active' GROUP BY ROLLUP (kind)")
def q5_stats(spark, sf_dir):
    """Q5: A1 A2."""
    return memory.stats(facts(spark, sf_dir))


@query(f"WITH {FACTS_SQL} SELECT id, account_id, text FROM facts WHERE status = 'active' AND kind = 'k3' ORDER BY age, id LIMIT 50")
def q5_list(spark, sf_dir):
    """Q5: P2 T5 P13."""
    return filters.where_equal(facts(spark, sf_dir), status="active", kind="k3", text="").orderBy(F.desc("updated_at"), "id").limit(50).select("id", "account_id", "text")


@query(f"""WITH {FACTS_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY importance DESC, use_count DESC, age, id DESC) AS n FROM facts WHERE status = 'active')
    SELECT f.id, CASE WHEN r.n > 40 THEN 'superseded' ELSE f.status END AS status FROM facts f LEFT JOIN ranked r ON f.id = r.id""")
def m11_prune(spark, sf_dir):
    """A capacity of 40 for each account."""
    return state.prune(facts(spark, sf_dir), cap=40).select("id", "status")


@query(f"WITH {FACTS_SQL} SELECT account_id, greatest(count(*) - 40, 0) AS overflow FROM facts WHERE status = 'active' GROUP BY account_id")
def a3_overflow(spark, sf_dir):
    return agg.overflow(facts(spark, sf_dir), "account_id", 40)


@query(f"""WITH {SEVENTHS_SQL}, s AS (SELECT c.account_id, c.id AS cid, s.id, {COS_SQL.format("c.e", "s.e")} AS sim FROM facts c JOIN facts s ON c.account_id = s.account_id AND c.status <> 'active' AND s.status = 'active'),
    b AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY sim DESC, id) AS n FROM s WHERE sim > 0)
    SELECT c.account_id, c.id AS cid, CASE WHEN b.sim >= 0.3 THEN b.id END AS id, CASE WHEN b.sim >= 0.3 THEN b.sim END AS sim FROM facts c LEFT JOIN b ON b.cid = c.id AND b.n = 1 WHERE c.status <> 'active'""")
def j3_nearest(spark, sf_dir):
    """Retired facts against the active ones of their account."""
    f = facts(spark, sf_dir, sevenths=True)
    cand = f.where("status <> 'active'").select("account_id", F.col("id").alias("cid"), F.col("embedding").alias("cvec"))
    stored = f.where("status = 'active'").select("account_id", "id", F.col("embedding").alias("vec"), F.col("id").alias("seq"))
    return matching.nearest(cand, stored, 0.3, keys=["account_id"])


@query(f"WITH {SEVENTHS_SQL} SELECT a.id FROM facts a WHERE EXISTS (SELECT 1 FROM facts b WHERE a.account_id = b.account_id AND a.id <> b.id AND {COS_SQL.format('a.e', 'b.e')} >= 0.3)")
def j7_exists_similar(spark, sf_dir):
    f = facts(spark, sf_dir, sevenths=True).select("account_id", "id", F.col("embedding").alias("vec"))
    return matching.exists_similar(f, ["account_id"], 0.3).select("id")


@query(f"""WITH {SEVENTHS_SQL}, w AS (SELECT DISTINCT vec_id * 2 AS id FROM embeddings), full_ AS (SELECT account_id, count(*) >= 66 AS f FROM facts WHERE status = 'active' GROUP BY 1)
    SELECT w.id, CASE WHEN a.id IS NULL THEN 'missing' WHEN a.status = 'active' THEN 'ok' WHEN coalesce(full_.f, false) THEN 'capacity'
      WHEN EXISTS (SELECT 1 FROM facts b WHERE b.status = 'active' AND b.account_id = a.account_id AND b.id <> a.id AND {COS_SQL.format("a.e", "b.e")} >= 0.3) THEN 'duplicate' ELSE 'ok' END AS verdict
    FROM w LEFT JOIN facts a ON a.id = w.id LEFT JOIN full_ ON full_.account_id = a.account_id""")
def q12_restorable(spark, sf_dir):
    """Q12 M13."""
    f = facts(spark, sf_dir, sevenths=True)
    return memory.restorable(f, f.select((F.col("id") * 2).alias("id")), least=0.3, cap=66)


@query(f"""WITH RECURSIVE {FACTS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY id) AS k FROM facts WHERE status <> 'active'),
    s AS (SELECT n.id AS cid, arg_max(f.id, {COS_SQL.format("n.e", "f.e")}) AS id, max({COS_SQL.format("n.e", "f.e")}) AS sim FROM n JOIN facts f ON f.account_id = n.account_id AND f.status = 'active' GROUP BY ALL),
    c AS (SELECT x.id AS cid, list({{'sim': {COS_SQL.format("x.e", "y.e")}, 'o': -y.id}}) AS others FROM n x JOIN n y ON x.account_id = y.account_id AND y.k < x.k GROUP BY ALL),
    walk AS (SELECT DISTINCT account_id, 0::BIGINT AS k, []::BIGINT[] AS added, NULL::BIGINT AS cid, NULL::BIGINT AS target FROM n
        UNION ALL SELECT account_id, k, CASE WHEN target = cid THEN list_append(added, cid) ELSE added END, cid, target
          FROM (SELECT account_id, k, added, cid, CASE WHEN greatest(coalesce(b.sim, 0), coalesce(sim, 0)) < 0.3 THEN cid WHEN coalesce(b.sim, 0) > coalesce(sim, 0) THEN -b.o ELSE id END AS target
            FROM (SELECT w.account_id, n.k, w.added, n.id AS cid, s.id, s.sim, list_max(list_filter(coalesce(c.others, []), lambda x: list_contains(w.added, -x.o))) AS b FROM walk w JOIN n ON n.account_id = w.account_id AND n.k = w.k + 1 LEFT JOIN s ON s.cid = n.id LEFT JOIN c ON c.cid = n.id))),
    u AS (SELECT w.target AS id, arg_max(n.text, w.k) AS text, max(n.importance) AS importance, bool_or(w.target = w.cid) AS own FROM walk w JOIN n ON n.id = w.cid GROUP BY w.target)
    SELECT f.account_id, f.id::VARCHAR AS id, coalesce(u.text, f.text) AS text, greatest(f.importance, coalesce(u.importance, f.importance)) AS importance, CASE WHEN u.id IS NULL THEN 'keep' WHEN own THEN 'add' ELSE 'update' END AS op
    FROM facts f LEFT JOIN u ON u.id = f.id WHERE f.status = 'active' OR own""")
def m3_semantic_upsert(spark, sf_dir):
    """M3 Q4: retired facts offered again to the active ones of their account, in order."""
    f = facts(spark, sf_dir).withColumn("vec", F.col("embedding").cast("array<double>")).withColumn("id", F.col("id").cast("string"))
    new = f.where("status <> 'active'").withColumn("seq", F.col("id").cast("long"))
    return matching.semantic_upsert(f.where("status = 'active'"), new, least=0.3).select("account_id", "id", "text", "importance", "op")


@query(f"WITH {FACTS_SQL} SELECT id, use_count + (id % 5 = 0)::INT AS use_count, CASE WHEN id % 5 = 0 THEN {NOW} END AS last_used_at FROM facts")
def m6_count_uses(spark, sf_dir):
    f = facts(spark, sf_dir).withColumn("last_used_at", F.lit(None).cast("timestamp_ntz"))
    return state.count_uses(f, f.where("id % 5 = 0").select("id"), F.expr("TIMESTAMP_NTZ '2024-02-01 00:00:00'")).select("id", "use_count", "last_used_at")


NORMAL_SQL = r"regexp_replace(lower(text), '[\s\x0B\p{P}]+', '', 'g')"


@query(f"SELECT doc_id, sha1({NORMAL_SQL}) AS fingerprint FROM documents")
def f19_fingerprint(spark, sf_dir):
    """F18 F19."""
    return table(spark, sf_dir, "documents").select("doc_id", hashes.fingerprint(F.col("text")).alias("fingerprint"))


@query(f"SELECT lang, count(*) AS n, count(DISTINCT sha1({NORMAL_SQL})) AS distinct_n, 1 - count(DISTINCT sha1({NORMAL_SQL})) / count(*)::DOUBLE AS duplicate_rate FROM documents GROUP BY lang")
def a15_duplicate_rate(spark, sf_dir):
    """A15 A16."""
    return agg.duplicate_rate(table(spark, sf_dir, "documents"), hashes.fingerprint(F.col("text")), "lang")


@query(f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY sha1({NORMAL_SQL}) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def m14_unique(spark, sf_dir):
    """The first of each fingerprint."""
    docs = table(spark, sf_dir, "documents").select("doc_id", hashes.fingerprint(F.col("text")).alias("f"))
    return docs.groupBy("f").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


SIMHASH_SQL = r"""items AS (SELECT item_id AS id, regexp_replace(lower(text), '[\s\x0B\p{P}]+', '', 'g') AS s FROM benchmark),
    grams AS (SELECT id, unnest(list_transform(range(1, length(s) - 1), lambda i: ('0x' || substr(md5(substr(s, i, 3)), 1, 15))::BIGINT)) AS g FROM items),
    votes AS (SELECT id, b, sum(CASE WHEN (g >> b) & 1 = 1 THEN 1 ELSE -1 END) AS v FROM grams, (SELECT unnest(range(60))::BIGINT AS b) GROUP BY ALL),
    sim AS (SELECT id, sum(CASE WHEN v > 0 THEN 1::BIGINT << b ELSE 0 END)::BIGINT AS simhash FROM votes GROUP BY id)"""


# Classes of equal hashes by their least ids: pairs of classes, and the further members of each.
NEAR_SQL = """r AS (SELECT simhash, min(id) AS rep FROM sim WHERE simhash IS NOT NULL GROUP BY simhash)
    SELECT least(x.rep, y.rep) AS a, greatest(x.rep, y.rep) AS b, bit_count(xor(x.simhash, y.simhash))::BIGINT AS distance FROM r x JOIN r y ON x.simhash < y.simhash WHERE bit_count(xor(x.simhash, y.simhash)) <= 3
    UNION ALL SELECT rep, id, 0 FROM sim JOIN r USING (simhash) WHERE id <> rep"""


@query(f"WITH {SIMHASH_SQL} SELECT id, simhash FROM sim")
def f20_simhash(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), hashes.normalized(F.col("text")).alias("s"))
    return items.select("id", hashes.simhash(F.col("s")).alias("simhash"))


@query(f"WITH {SIMHASH_SQL}, {NEAR_SQL}")
def j4_near_questions(spark, sf_dir):
    """Pairs of classes within 3 bits by four bands, and members."""
    return matching.near_hashes(f20_simhash(spark, sf_dir), "id", "simhash", 3)


SIMHASH_DOCUMENTS_SQL = SIMHASH_SQL.replace("item_id", "doc_id").replace("benchmark", "documents")


@query(f"WITH {SIMHASH_DOCUMENTS_SQL} SELECT documents.doc_id AS id, simhash FROM documents LEFT JOIN sim ON sim.id = documents.doc_id")
def f20_simhash_documents(spark, sf_dir):
    """F20 over documents."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("id"), hashes.simhash(hashes.normalized(F.col("text"))).alias("simhash"))


@query(f"WITH {SIMHASH_DOCUMENTS_SQL}, {NEAR_SQL}")
def j4_near_documents(spark, sf_dir):
    """J4 F21 over documents."""
    return matching.near_hashes(written(f20_simhash_documents(spark, sf_dir), "simhash"), "id", "simhash", 3)


@query("""SELECT event_id, ts FROM events WHERE CASE event_id % 4 WHEN 0 THEN 'invalid' WHEN 1 THEN 'duplicate' WHEN 2 THEN 'novel' ELSE 'unknown' END NOT IN ('invalid', 'duplicate')""")
def p12_kept_frames(spark, sf_dir):
    """Events stand for frames."""
    k = F.col("event_id") % 4
    frames = table(spark, sf_dir, "events").withColumn("novelty_status", F.when(k == 0, "invalid").when(k == 1, "duplicate").when(k == 2, "novel").otherwise("unknown"))
    return filters.kept_frames(frames).select("event_id", "ts")


@query("""WITH RECURSIVE f AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, CASE WHEN event_id % 17 > 0 THEN xor(('0x' || substr(md5(event_type), 1, 15))::BIGINT, 1::BIGINT << (event_id % 5)::INT) END AS h,
        ['a' || (event_id % 3), event_type, 'v' || floor(value / 20)::BIGINT] AS t FROM events),
    walk AS (SELECT user_id, 0::BIGINT AS k, NULL::BIGINT AS event_id, NULL::BIGINT AS h, NULL::VARCHAR[] AS t, NULL::VARCHAR AS status, NULL::INTEGER AS visual, NULL::DOUBLE AS text FROM f WHERE k = 1
        UNION ALL SELECT user_id, k, event_id, CASE WHEN status = 'novel' THEN fh ELSE h END, CASE WHEN status = 'novel' THEN ft ELSE t END, status, visual, text
          FROM (SELECT *, CASE WHEN fh IS NULL THEN 'invalid' WHEN visual <= 5 AND text < 0.5 THEN 'duplicate' ELSE 'novel' END AS status
            FROM (SELECT w.user_id, f.k, f.event_id, f.h AS fh, f.t AS ft, w.h, w.t, CASE WHEN f.h IS NOT NULL AND w.h IS NOT NULL THEN bit_count(xor(f.h, w.h))::INTEGER END AS visual,
                CASE WHEN f.h IS NOT NULL AND w.h IS NOT NULL THEN 1 - len(list_intersect(f.t, w.t)) / len(list_distinct(list_concat(f.t, w.t)))::DOUBLE END AS text FROM walk w JOIN f ON f.user_id = w.user_id AND f.k = w.k + 1)))
    SELECT user_id, event_id, status AS novelty_status, visual AS visual_distance, text AS text_distance FROM walk WHERE k > 0""")
def x4_novel_frames(spark, sf_dir):
    """Events stand for frames; change is held against the last novel one."""
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    base = F.conv(F.substring(F.md5(F.encode("event_type", "UTF-8")), 1, 15), 16, 10).cast("long")
    flipped = base.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), (n % 5).cast("int")))
    tokens = F.array(F.concat(F.lit("a"), (n % 3).cast("string")), F.col("event_type"), F.concat(F.lit("v"), F.floor(F.col("value") / 20).cast("string")))
    frames = e.select(F.col("user_id").alias("session_id"), F.lit("").alias("image_id"), n.alias("sequence_index"), F.when(n % 17 > 0, flipped).alias("visual_hash"), tokens.alias("tokens"))
    out = agg.novel_frames(frames)
    return out.select(F.col("session_id").alias("user_id"), F.col("sequence_index").alias("event_id"), "novelty_status", "visual_distance", "text_distance")


@query("""SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS review_state, o_orderdate AS next_review_at FROM orders
    WHERE contains(o_orderpriority, 'MEDIUM') AND (o_orderdate IS NULL OR o_orderdate <= TIMESTAMP '1996-01-01') ORDER BY 2, 3, 4 NULLS FIRST, 1 LIMIT 20""")
def p11_review_queue(spark, sf_dir):
    """Orders stand for mistakes."""
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("review_state"), F.col("o_orderdate").alias("next_review_at"))
    return filters.review_queue(items, F.lit("1996-01-01").cast("timestamp_ntz"), due_only=True, q="MEDIUM", fields=["review_state"], page_size=20)


@query("""SELECT o_custkey AS session_id, count(*) AS questions, count(*) FILTER (o_orderstatus = 'F') AS mistakes, count(DISTINCT o_orderpriority) AS subjects FROM orders GROUP BY 1""")
def a17_session_counts(spark, sf_dir):
    """Orders stand for questions, customers for sessions."""
    items = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderpriority").alias("subject"), (F.col("o_orderstatus") == "F").alias("mistake"))
    return agg.session_counts(items)


@query("""SELECT user_id AS account_id, event_type AS scope, count(*) AS source_count, max(ts) AS latest_event_at FROM events GROUP BY 1, 2""")
def a18_profiles(spark, sf_dir):
    """A18."""
    return agg.profiles(table(spark, sf_dir, "events").select(F.col("user_id").alias("account_id"), F.col("event_type").alias("scope"), "ts"), "ts")


# A document goes if one before it, of its source and near its hash, stays; those in question are walked in order.
QUESTION_SET_SQL = f"""WITH RECURSIVE {SIMHASH_DOCUMENTS_SQL},
    firsts AS (SELECT source, sha1({NORMAL_SQL}) AS fingerprint, min(doc_id) AS id FROM documents WHERE regexp_matches(coalesce(text, ''), '\\S') GROUP BY ALL),
    u AS (SELECT firsts.*, simhash FROM firsts LEFT JOIN sim USING (id)),
    n AS (SELECT source, simhash, min(id) AS id FROM u WHERE simhash IS NOT NULL GROUP BY ALL),
    c AS (SELECT b.id, list(a.id) AS earlier FROM n a JOIN n b ON a.source = b.source AND a.id < b.id AND bit_count(xor(a.simhash, b.simhash)) <= 3 GROUP BY b.id),
    o AS (SELECT row_number() OVER (ORDER BY id) AS k, id, earlier FROM c),
    walk(k, gone) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT o.k, CASE WHEN len(list_filter(o.earlier, lambda x: NOT list_contains(gone, x))) > 0 THEN list_append(gone, o.id) ELSE gone END FROM walk JOIN o ON o.k = walk.k + 1)
    SELECT u.id AS doc_id, fingerprint FROM u WHERE (simhash IS NULL OR id IN (SELECT id FROM n)) AND id NOT IN (SELECT unnest(gone) FROM (SELECT gone FROM walk ORDER BY k DESC LIMIT 1))"""


@query(QUESTION_SET_SQL)
def q6_question_set(spark, sf_dir):
    """Documents kept of each source, first ones first."""
    items = table(spark, sf_dir, "documents").select(F.col("source").alias("session"), "doc_id", F.col("text").alias("stem"))
    return study.question_set(items, ["session"], ["doc_id"]).select("doc_id", "fingerprint")


# Every sentence is a question on the page of its document; its picture and place follow from its text and its place in order.
SENTENCES_SQL = rf"""s AS (SELECT source, doc_id, i, regexp_replace(lower(t), '[\s\x0B\p{{P}}]+', '', 'g') AS s FROM (SELECT source, doc_id, unnest(p) AS t, unnest(range(len(p))) AS i FROM (SELECT *, regexp_split_to_array(text, '\.\s*') AS p FROM documents WHERE text IS NOT NULL)) WHERE regexp_matches(t, '\S')),
    d AS (SELECT source, sha1(s) AS fingerprint, any_value(s) AS s, min({{'d': doc_id, 'i': i}}) AS o FROM s GROUP BY ALL),
    q AS (SELECT source, fingerprint, o, s, length(s) AS n, xor(('0x' || substr(md5(s[1:2]), 1, 15))::BIGINT, 1::BIGINT << (o.d % 4)::INT) AS crop, 0.1 + 0.2 * (o.i % 4) + 0.02 * (o.d % 3) AS cx, 0.05 + 0.15 * (o.i // 4 % 6) + 0.02 * (o.d % 2) AS cy FROM d),
    grams AS (SELECT source, o, unnest(list_transform(range(1, length(s) - 1), lambda k: ('0x' || substr(md5(substr(s, k, 3)), 1, 15))::BIGINT)) AS g FROM q),
    votes AS (SELECT source, o, {", ".join(f"sum((g >> {b}) & 1) * 2 > count(*) AS v{b}" for b in range(60))} FROM grams GROUP BY ALL),
    h AS (SELECT source, o, ({" + ".join(f"v{b}::BIGINT * {1 << b}" for b in range(60))})::BIGINT AS h FROM votes),
    x AS (SELECT q.*, h.h FROM q LEFT JOIN h USING (source, o)),
    c AS (SELECT b.source, b.o, list(a.o) AS earlier FROM x a JOIN x b ON a.source = b.source AND a.o < b.o
          AND CASE WHEN b.n >= 12 THEN bit_count(xor(a.h, b.h)) <= 3 ELSE bit_count(xor(a.crop, b.crop)) <= 5 AND abs(a.cx - b.cx) <= 0.05 AND abs(a.cy - b.cy) <= 0.05 END GROUP BY ALL),
    o AS (SELECT row_number() OVER (PARTITION BY source ORDER BY o) AS k, * FROM c)"""


@query(f"""WITH RECURSIVE {SENTENCES_SQL},
    walk(source, k, gone) AS (SELECT DISTINCT source, 0::BIGINT, []::STRUCT(d BIGINT, i BIGINT)[] FROM o
        UNION ALL SELECT o.source, o.k, CASE WHEN len(list_filter(o.earlier, lambda e: NOT list_contains(gone, e))) > 0 THEN list_append(gone, o.o) ELSE gone END FROM walk JOIN o ON o.k = walk.k + 1 AND o.source = walk.source),
    gone AS (SELECT source, unnest(arg_max(gone, k)) AS o FROM walk GROUP BY source)
    SELECT source, x.o.d AS doc_id, x.o.i AS i, x.n AS stem_length, fingerprint FROM x ANTI JOIN gone USING (source, o)""")
def j13_short_questions(spark, sf_dir):
    """Sentences stand for questions, with crops and boxes made by rule; short ones go by picture and place."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    parts = docs.select("source", "doc_id", F.posexplode(F.split("text", r"\.\s*")).alias("i", "stem"))
    base = F.conv(F.substring(F.md5(F.encode(F.substring(hashes.normalized(F.col("stem")), 1, 2), "UTF-8")), 1, 15), 16, 10).cast("long")
    crop = base.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("doc_id") % 4).cast("int")))
    x, y = 0.1 + 0.2 * (F.col("i") % 4) + 0.02 * (F.col("doc_id") % 3), 0.05 + 0.15 * (F.floor(F.col("i") / 4) % 6) + 0.02 * (F.col("doc_id") % 2)
    zero = F.lit(0.0)
    items = parts.select("source", "doc_id", "i", "stem", crop.alias("crop_hash"), F.struct(x.alias("x"), y.alias("y"), zero.alias("w"), zero.alias("h")).alias("box"))
    kept = study.illustrated_question_set(items, ["source"], ["doc_id", "i"])
    return kept.select("source", "doc_id", F.col("i").cast("long").alias("i"), F.col("stem_length").cast("long").alias("stem_length"), "fingerprint")


@query("SELECT doc_id FROM documents WHERE contains(text, 'idiot') OR contains(text, 'clown') OR (source = 'src1' AND lang <> 'en')")
def q7_cleanup(spark, sf_dir):
    """Q7 P5 P6, with markers of the test texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("evidence"), F.when(F.col("source") == "src1", "observation").alias("detection_method"), F.when(F.col("lang") == "en", "candidate").otherwise("open").alias("status"))
    return study.cleanup_targets(docs, columns=("evidence",), markers=("idiot", "clown")).select("doc_id")


@query("SELECT doc_id, lang FROM documents WHERE NOT (contains(text, 'idiot') OR contains(text, 'clown'))")
def m12_delete(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    bad = docs.where(text.any_of(F.col("text"), ("idiot", "clown"))).select("doc_id")
    return state.delete(docs.select("doc_id", "lang"), bad, "doc_id")


@query(r"""WITH s AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents),
    m AS (SELECT *, chr(10) || '...[已按 token 预算截断约 ' || (length(t) - 400) || ' 字]...' || chr(10) AS mark FROM s),
    h AS (SELECT *, greatest(1, floor((400 - length(mark)) * 0.72)::INT) AS head FROM m)
    SELECT doc_id, CASE WHEN length(t) <= 400 THEN t ELSE regexp_replace(substr(t, 1, head), '\s+$', '') || mark || regexp_replace(right(t, 400 - length(mark) - head), '^\s+', '') END AS cut FROM h""")
def f14_head_tail(spark, sf_dir):
    """F13 F14."""
    return table(spark, sf_dir, "documents").select("doc_id", text.head_tail(F.col("text"), 400).alias("cut"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY ROLLUP (event_type)")
def a2_counts(spark, sf_dir):
    return agg.counts_with_total(table(spark, sf_dir, "events"), "event_type")


@query("SELECT user_id, count(*) FILTER (event_type <> 'click') AS adds, count(*) FILTER (event_type = 'click') AS updates FROM events GROUP BY user_id")
def a4_deltas(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("op", F.when(F.col("event_type") == "click", "update").otherwise("add"))
    return agg.delta_counts(e, "user_id")


@query("""SELECT user_id, count(*) FILTER (value > 50) AS done, count(*) AS total, avg(value) FILTER (value > 50) AS avg_ms,
    round((count(*) - count(*) FILTER (value > 50)) * avg(value) FILTER (value > 50))::BIGINT AS eta_ms FROM events GROUP BY user_id""")
def a5_progress(spark, sf_dir):
    return agg.progress(table(spark, sf_dir, "events"), F.col("value") > 50, F.col("value"), "user_id", order="event_id")


@query("SELECT event_type, (count(*) + 1) * greatest(20, avg(value) / 1000) AS eta FROM events GROUP BY event_type")
def a6_queue_eta(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(agg.queue_eta(F.count("*"), F.avg("value")).alias("eta"))


@query("SELECT user_id, ts::DATE AS day, count(*) AS used, greatest(5 - count(*), 0) AS \"left\" FROM events GROUP BY ALL")
def a7_quota(spark, sf_dir):
    """A7 Q13."""
    return agg.daily_quota(table(spark, sf_dir, "events"), "user_id", "ts", 5)


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", avg(o_totalprice) AS avg_wait FROM orders GROUP BY o_orderpriority")
def a14_status_board(spark, sf_dir):
    return agg.status_board(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O"], F.col("o_totalprice"))


@query("SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, min(event_id) AS first_sequence, max(event_id) AS last_sequence, count(*) AS evidence_count, list_sort(list_distinct(list(event_type))) AS images FROM events GROUP BY user_id")
def a13_evidence(spark, sf_dir):
    return agg.merged_evidence(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", "event_type")


@query("SELECT event_type, median(value) AS median_value, avg(value) AS avg_value, arg_max(event_id, value) AS best FROM events GROUP BY event_type")
def a9_median(spark, sf_dir):
    """A8 A9 A12."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.median("value").alias("median_value"), F.avg("value").alias("avg_value"), F.max_by("event_id", "value").alias("best"))


@query("SELECT conv_id, string_agg(role || ': ' || turn, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def a11_text_of(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("line", F.concat_ws(": ", "role", F.col("turn").cast("string")))
    return agg.text_of(turns, ["conv_id"], ["turn"], "line")


@query("""WITH m AS (SELECT *, epoch_us(ts) / 1e6 AS s FROM events), g AS (SELECT *, coalesce((s - lag(s) OVER (PARTITION BY user_id ORDER BY ts) > 21600)::INT, 0) AS n FROM m),
    r AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING)::BIGINT AS stay FROM g)
    SELECT user_id, stay, min(ts) AS start, max(ts) AS "end", count(*) AS events, max(s) - min(s) AS seconds FROM r GROUP BY user_id, stay""")
def w6_dwell(spark, sf_dir):
    """W6 W7."""
    return agg.dwell(table(spark, sf_dir, "events"), ["user_id"], "ts", 6 * 3600)


@query("SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def w8_latest(spark, sf_dir):
    own = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return own.groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))


@query("""WITH n AS (SELECT *, lead(role) OVER w AS r, lead(text) OVER w AS t FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS round, text AS question, CASE WHEN r = 'assistant' THEN t END AS reply FROM n WHERE role = 'user'""")
def w9_rounds(spark, sf_dir):
    return agg.rounds(table(spark, sf_dir, "conversations"))


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def w10_last(spark, sf_dir):
    return ranking.last_lines(table(spark, sf_dir, "events"), 20, "ts", "event_id").select("event_id", "ts")


@query("SELECT event_id, user_id FROM events WHERE ts > TIMESTAMP '2024-01-20' AND value <= 50 ORDER BY ts DESC, event_id LIMIT 200")
def x1_unseen(spark, sf_dir):
    """X1 P4."""
    from lodestone.streaming.feeds import unseen

    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", F.col("ts").alias("created_at"), (F.col("value") > 50).alias("seen"))
    since = F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'")
    return unseen(e.where(F.col("created_at") > since), None, 200).select(F.col("id").alias("event_id"), "user_id")


@query("SELECT event_id, value > 50 OR event_id % 3 = 0 AS seen FROM events")
def m8_mark_seen(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("value") > 50).alias("seen"))
    return state.mark_seen(e, e.where("id % 3 = 0").select("id")).select(F.col("id").alias("event_id"), "seen")


@query("SELECT event_id, greatest(0, least(1, coalesce(try_cast(props->>'$.k' AS DOUBLE), 0.5))) AS k FROM events")
def f11_props(spark, sf_dir):
    """F10 F11."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", text.number_or(text.json_object(F.col("props"), "k string")["k"]).alias("k"))


@query("""SELECT event_id, CASE WHEN event_id % 7 IN (0, 1, 2, 6) THEN props->>'$.k' END AS k, CASE event_id % 7 WHEN 6 THEN 'deep' END AS note FROM events""")
def f10_payloads(spark, sf_dir):
    """objects fenced, amid prose, within lists, cut off; fields that no schema names."""
    e, n, p = table(spark, sf_dir, "events"), F.col("event_id") % 7, F.col("props")
    told = F.when(n == 0, p).when(n == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(n == 2, F.concat(F.lit("here you are: "), p, F.lit(" as asked")))
    told = told.when(n == 3, F.concat(F.lit("["), p, F.lit("]"))).when(n == 4, F.substring(p, F.lit(1), F.length(p) - 1)).when(n == 6, F.concat(F.regexp_replace(p, r"\}$", ""), F.lit(', "more": {"note": ["deep"]}}')))
    found = e.select("event_id", text.payload(told).alias("v"))
    return found.select("event_id", text.field(F.col("v"), "k").alias("k"), text.field(F.col("v"), "more.note[0]").alias("note"))


@query("""SELECT vec_id, len(embedding) AS dims, round(list_sum(list_transform(embedding, lambda x: x::VARCHAR::DOUBLE)), 6) AS total FROM embeddings WHERE vec_id % 6 IN (0, 5)""")
def p17_text_vectors(spark, sf_dir):
    """Vectors kept as JSON text; cut off, objects, empty lists and lists with a text go."""
    n, t = F.col("vec_id") % 6, F.to_json("embedding")
    told = F.when(n == 0, t).when(n == 1, F.substring(t, F.lit(1), F.length(t) - 1)).when(n == 2, F.concat(F.lit('{"v": '), t, F.lit("}"))).when(n == 3, "[]").when(n == 4, F.regexp_replace(t, "^.", '["x", ')).otherwise(F.regexp_replace(t, ",", " , "))
    v = filters.sound_vectors(table(spark, sf_dir, "embeddings").select("vec_id", told.alias("embedding")))
    return v.select("vec_id", F.size("embedding").cast("long").alias("dims"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def cut_sql(size: str) -> str:
    """The text t, stripped, cut to a number of characters."""
    s = r"regexp_replace(t, '^\s+|\s+$', '', 'g')"
    mark = f"chr(10) || '...[已按 token 预算截断约 ' || (length({s}) - {size}) || ' 字]...' || chr(10)"
    head = f"greatest(1, floor(({size} - length({mark})) * 0.72)::INT)"
    return rf"""CASE WHEN length({s}) <= {size} THEN {s} ELSE regexp_replace(substr({s}, 1, {head}), '\s+$', '') || {mark} || regexp_replace(right({s}, {size} - length({mark}) - {head}), '^\s+', '') END"""


def budget_sql(budget: int, floor: int, rounds: int) -> str:
    notice = "'short: '"
    steps = ["r0 AS (SELECT doc_id, coalesce(text, '') AS t, true AS go FROM documents)"]
    for k in range(rounds):
        n = r"len(regexp_extract_all(t, '\S+'))"
        steps.append(f"c{k} AS (SELECT *, go AND {n} > {budget} AND length(t) > {floor} AS more, least(greatest({floor}, floor(length(t) * ({budget}::DOUBLE / greatest({n}, 1)) * 0.82::DOUBLE)::INT), length(t) - 1) AS size FROM r{k})")
        steps.append(f"d{k} AS (SELECT doc_id, t, more, CASE WHEN more THEN {cut_sql('size')} END AS cut FROM c{k})")
        steps.append(f"r{k + 1} AS (SELECT doc_id, more AS go, CASE WHEN NOT more THEN t WHEN starts_with(cut, {notice}) THEN cut ELSE {notice} || chr(10) || chr(10) || cut END AS t FROM d{k})")
    return f"WITH {', '.join(steps)} SELECT doc_id, t AS text FROM r{rounds}"


@query(budget_sql(150, 300, 6))
def f15_budget(spark, sf_dir):
    """texts cut until they have 150 words; the counter is a column function that is passed in."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return text.fit_to_budget(docs, "text", lambda x: F.regexp_count(x, F.lit(r"\S+")), 150, notice="short: ", floor=300)


@query("""SELECT l.l_orderkey, l.l_linenumber, l.l_quantity, o.o_orderstatus AS session_status FROM lineitem l LEFT JOIN orders o ON o.o_orderkey = l.l_orderkey WHERE l.l_returnflag = 'R'""")
def j8_enriched(spark, sf_dir):
    """J8 J9 J11."""
    items = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_quantity")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("session_status"))
    return items.join(orders, "l_orderkey", "left")


@query("""SELECT m.kind, m.id, d.text AS body FROM (SELECT 'mistake' AS kind, o_orderkey AS id FROM orders UNION ALL SELECT 'learning', c_custkey FROM customer) m
    LEFT JOIN (SELECT CASE WHEN doc_id % 2 = 0 THEN 'mistake' ELSE 'learning' END AS kind, doc_id AS id, text FROM documents) d ON d.kind = m.kind AND d.id = m.id""")
def j9_bodies(spark, sf_dir):
    """A left join on kind and id."""
    orders, customers = (table(spark, sf_dir, t).select(F.lit(k).alias("kind"), F.col(c).alias("id")) for t, k, c in (("orders", "mistake", "o_orderkey"), ("customer", "learning", "c_custkey")))
    bodies = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 2 == 0, "mistake").otherwise("learning").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("body"))
    return orders.unionByName(customers).join(bodies, ["kind", "id"], "left").select("kind", "id", "body")


@query("""WITH g AS (SELECT vec_id AS id, embedding[1:64]::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
    v AS (FROM g UNION ALL SELECT id + 1000000, list_concat([-e[1], -e[2]], e[3:64]) FROM g), sim AS (SELECT id, array_to_string(list_transform(e, lambda x: CASE WHEN x >= list_avg(e) THEN '1' ELSE '0' END), '') AS h FROM v),
    r AS (SELECT h, min(id) AS rep FROM sim GROUP BY h)
    SELECT least(x.rep, y.rep) AS a, greatest(x.rep, y.rep) AS b, hamming(x.h, y.h) AS distance FROM r x JOIN r y ON x.h < y.h WHERE hamming(x.h, y.h) <= 5
    UNION ALL SELECT rep, id, 0 FROM sim JOIN r USING (h) WHERE id <> rep""")
def j5_near_images(spark, sf_dir):
    """Average hashes within 5 bits; the first 64 values of a vector stand for a grid of luma, and each has a next frame."""
    grids = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.slice(F.col("embedding").cast("array<double>"), 1, 64).alias("g"))
    after = grids.select((F.col("id") + 1_000_000).alias("id"), F.concat(F.transform(F.slice("g", 1, 2), lambda x: -x), F.slice("g", 3, 62)).alias("g"))
    images = grids.unionByName(after).select("id", hashes.packed(hashes.average_hash(F.col("g"))).alias("hash"))
    return matching.near_hashes(written(images, "images"), "id", "hash", 5)


@query("""WITH f AS (SELECT o.o_orderkey AS id, o.o_custkey AS session_id, o_totalprice FROM orders o WHERE o_orderstatus = 'F' AND contains(o_orderpriority, 'HIGH')), t AS (SELECT count(*) AS total FROM f)
    SELECT p.session_id, p.id, p.o_totalprice, t.total, true AS has_prev, t.total > 60 AS has_next, 41 AS "first", least(60, t.total) AS "last", c.c_name AS session_title
    FROM (SELECT * FROM f ORDER BY o_totalprice DESC, id LIMIT 20 OFFSET 40) p CROSS JOIN t LEFT JOIN customer c ON c.c_custkey = p.session_id""")
def q9_browse(spark, sf_dir):
    """Q9 P9 T6 J8."""
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("session_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("subject"), "o_totalprice", F.lit("mistake").alias("kind"))
    sessions = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id"), F.col("c_name").alias("session_title"))
    out = study.browse(items, sessions, kind="mistake", number=3, size=20, order=[F.desc("o_totalprice"), F.col("id")], equal={"status": "F", "item_type": "ignored"}, contains={"subject": "HIGH"})
    return out.select("session_id", "id", "o_totalprice", "total", "has_prev", "has_next", "first", "last", "session_title")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '已确认' WHEN 'O' THEN '未完成' ELSE o_orderstatus END AS label, CASE o_orderstatus WHEN 'F' THEN 'warn' ELSE 'danger' END AS tone, substr(o_orderkey::VARCHAR, 1, 8) AS short FROM orders")
def f31_labels(spark, sf_dir):
    """F31 F33."""
    o = table(spark, sf_dir, "orders").withColumn("s", labels.coded(F.col("o_orderstatus"), {"F": "confirmed", "O": "incomplete"}, F.col("o_orderstatus")))
    return o.select("o_orderkey", labels.label(F.col("s"), labels.STATUSES, "候选").alias("label"), labels.coded(F.col("s"), labels.STATUS_TONES, "danger").alias("tone"), text.short_id(F.col("o_orderkey").cast("string")).alias("short"))


@query("""SELECT p_type AS key, 'mine ' || p_type AS template, true AS is_custom FROM part WHERE p_size % 3 = 0 GROUP BY p_type
    UNION ALL SELECT p_type, CASE WHEN max(p_size % 5 = 0) THEN 'old ' || p_type ELSE 'default ' || p_type END, max(p_size % 5 = 0) FROM part GROUP BY p_type HAVING NOT max(p_size % 3 = 0)""")
def j1_prompts(spark, sf_dir):
    """J1 Q10."""
    part = table(spark, sf_dir, "part").select(F.col("p_type").alias("key"), "p_size")
    named = lambda df, word: df.select("key").distinct().select("key", F.concat(F.lit(word), "key").alias("template"))
    return study.effective_prompts(named(part, "default "), named(part.where("p_size % 3 = 0"), "mine ").withColumn("account_id", F.lit("a")), named(part.where("p_size % 5 = 0"), "old "), "a")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer
    UNION ALL SELECT c_custkey + 1000000, c_acctbal + 1 FROM customer WHERE c_custkey % 4 = 0""")
def m1_upsert(spark, sf_dir):
    """M1 M2."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    some = c.where("c_custkey % 4 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1)
    return state.upsert(c, some.unionByName(some.withColumn("c_custkey", F.col("c_custkey") + 1000000)), "c_custkey")


@query("SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END, ''), 'local') AS c_mktsegment FROM customer")
def m9_backfill(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    return state.backfill(c, "c_mktsegment", "local")


@query("SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'mastered' ELSE o_orderstatus END AS status, CASE WHEN o_orderstatus <> 'F' THEN o_orderdate END AS next_review_at FROM orders")
def m10_settle(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "resolved").otherwise(F.col("o_orderstatus")).alias("status"), F.col("o_orderdate").alias("next_review_at"))
    return state.settle(o)


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'ignored' WHEN 2 THEN 'mastered' ELSE 'suspected' END AS status,
    CASE o_orderkey % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'ignored' WHEN 2 THEN 'mastered' ELSE 'none' END AS review_state FROM orders""")
def m15_review_event(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    events = o.where("id % 5 < 3").select("id", F.element_at(F.array(F.lit("confirm"), F.lit("ignore"), F.lit("mastered")), (F.col("id") % 5 + 1).cast("int")).alias("action"))
    return state.review_event(o.withColumn("status", F.lit("suspected")).withColumn("review_state", F.lit("none")), events)


@query("SELECT o_custkey, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderdate, o_orderkey)::INT AS rank FROM orders) WHERE rank <= 2")
def t7_queue(spark, sf_dir):
    """The next two of each queue."""
    return ranking.top_by(table(spark, sf_dir, "orders"), ["o_custkey"], 2, F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_orderkey")).select("o_custkey", "o_orderkey", "rank")


@query("SELECT c_mktsegment FROM (SELECT DISTINCT c_mktsegment FROM customer UNION SELECT 'local')")
def s3_accounts(spark, sf_dir):
    from lodestone.sources.shards import accounts

    return accounts(table(spark, sf_dir, "customer"), "c_mktsegment")


@query("SELECT r_regionkey::BIGINT AS r_regionkey, r_name, 'none' AS note, NULL::DOUBLE AS weight FROM region")
def s5_conform(spark, sf_dir):
    from pyspark.sql import types as T

    from lodestone.sources.shards import conform

    schema = T.StructType([T.StructField("r_regionkey", T.LongType()), T.StructField("r_name", T.StringType()), T.StructField("note", T.StringType()), T.StructField("weight", T.DoubleType())])
    return conform(table(spark, sf_dir, "region"), schema, {"note": "none"})


@query("SELECT n_nationkey FROM nation WHERE contains(to_json({'n_nationkey': n_nationkey, 'n_name': n_name})::VARCHAR, 'N_1')")
def p15_row_holds(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name").where(filters.row_holds("N_1")).select("n_nationkey")


def regions_sql(by_column: bool) -> str:
    """Lines on pages, made from documents by rule: each dozen of sentences is a page; odd documents have two columns."""
    part = "CASE WHEN x + w / 2 >= split THEN 1 ELSE 0 END" if by_column else "0"
    return rf"""RECURSIVE raw AS (SELECT doc_id, unnest(p) AS t, unnest(range(len(p))) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '\.\s*') AS p FROM documents WHERE text IS NOT NULL)),
    lines AS (SELECT doc_id || ':' || (i // 12) AS page, CASE WHEN doc_id % 2 = 0 THEN 0.1 WHEN i % 2 = 0 THEN 0.06 ELSE 0.54 END::DOUBLE AS x, (0.02 + 0.075 * (i % 12) + 0.0041 * (length(t) % 7) + CASE WHEN i % 12 >= 6 THEN 0.05 ELSE 0 END)::DOUBLE AS y,
        CASE WHEN doc_id % 2 = 0 THEN 0.5 + 0.03 * (length(t) % 10) ELSE 0.25 + 0.01 * (length(t) % 10) END::DOUBLE AS w, (0.0213 + 0.0047 * (length(t) % 3))::DOUBLE AS h, (0.9 - 0.01 * (i % 12))::DOUBLE AS confidence,
        regexp_replace(CASE WHEN doc_id % 3 > 0 AND i % 3 = 1 THEN i || '. ' || t ELSE t END, '^\s+|\s+$', '', 'g') AS text FROM raw),
    l AS (SELECT *, regexp_matches(text, '^\s*(第)?[0-9一二三四五六七八九十]+\s*[、，,.\)）题]') AS num FROM lines WHERE text <> ''),
    s AS (SELECT page, avg(h) AS a, greatest(median(h), avg(h), 0.012) AS mh, min(x) AS bx, min(y) AS by_, max(x + w) AS br, max(y + h) AS bb, count(*) AS n FROM l GROUP BY page),
    c0 AS (SELECT *, least(0.95, greatest(br - bx + 2 * greatest(0.026, least(0.06, mh * 2.2)), 0.68)) AS cw, greatest(0, by_ - greatest(0.012, mh * 1.2)) AS cy, greatest(0.09, mh * 5) AS below, greatest(0.30, mh * 10) AS tall FROM s),
    c AS (SELECT *, least(greatest((bx + br) / 2 - cw / 2, 0.025), 0.975 - cw) AS cx, least(0.985, greatest(bb + below, cy + tall)) AS cb FROM c0),
    m AS (SELECT page, mid, lead(mid) OVER o - mid AS gap, row_number() OVER o AS i, count(*) OVER (PARTITION BY page) AS many, cw FROM (SELECT page, x + w / 2 AS mid, w, cw, cx FROM l JOIN c USING (page)) WHERE w <= cw * 0.72 AND mid BETWEEN cx AND cx + cw WINDOW o AS (PARTITION BY page ORDER BY mid)),
    g AS (SELECT page, mid + gap / 2 AS sx FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY gap DESC, i) AS best FROM m WHERE many >= 4 AND i >= 2 AND many - i >= 2) WHERE best = 1 AND gap >= greatest(0.16, cw * 0.22)),
    split AS (SELECT page, sx AS split, max(y + h) FILTER (x + w / 2 < sx) AS left_low, max(y + h) FILTER (x + w / 2 >= sx) AS right_low FROM l JOIN g USING (page) JOIN c USING (page)
        GROUP BY page, sx, n, cx, cw HAVING count(*) FILTER (x < sx AND x + w > sx) <= greatest(1, n // 5) AND left_low IS NOT NULL AND right_low IS NOT NULL AND sx - cx >= 0.24 AND cx + cw - sx >= 0.24),
    p AS (SELECT l.*, a, {part} AS part FROM l JOIN c USING (page) LEFT JOIN split USING (page)),
    o AS (SELECT *, row_number() OVER (PARTITION BY page, part ORDER BY y, x, text) AS k, count(*) FILTER (num) OVER (PARTITION BY page, part) >= 2 AS by_number FROM p),
    walk AS (SELECT page, part, 0::BIGINT AS k, 0 AS block, NULL::DOUBLE AS low FROM o WHERE k = 1
        UNION ALL SELECT page, part, k, block + new::INT, CASE WHEN new THEN y + h ELSE greatest(low, y + h) END FROM (SELECT w.page, w.part, o.k, w.block, w.low, o.y, o.h, CASE WHEN by_number THEN num ELSE w.low IS NULL OR o.y - w.low > a * 1.6 OR num END AS new FROM walk w JOIN o ON o.page = w.page AND o.part = w.part AND o.k = w.k + 1)),
    b0 AS (SELECT page, part, block, min(x) AS x, min(y) AS y, max(x + w) AS r, max(y + h) AS b, string_agg(text, chr(10) ORDER BY k) AS text, avg(confidence) AS confidence, list(x + w / 2) AS mids FROM o JOIN walk USING (page, part, k) WHERE block > 0 GROUP BY ALL),
    b1 AS (SELECT *, lead(y) OVER (PARTITION BY page, part ORDER BY block) - 0.012 AS bottom, r - x AS w FROM b0),
    b2 AS (SELECT b1.*, mh, cx, cy, cw, cb, split, least(0.985, greatest(left_low + below, cy + tall)) AS lb, least(0.985, greatest(right_low + below, cy + tall)) AS rb FROM b1 JOIN c USING (page) LEFT JOIN split USING (page)),
    b3 AS (SELECT *, split IS NOT NULL AND w < cw * 0.70 AS own, 2 * greatest(0, least(r, split) - greatest(x, cx)) + 0.05 * len(list_filter(mids, lambda m: m BETWEEN cx AND split)) - 0.1 * abs((x + r) / 2 - (cx + split) / 2) AS ls,
        2 * greatest(0, least(r, cx + cw) - greatest(x, split)) + 0.05 * len(list_filter(mids, lambda m: m BETWEEN split AND cx + cw)) - 0.1 * abs((x + r) / 2 - (split + cx + cw) / 2) AS rs FROM b2),
    b4 AS (SELECT *, CASE WHEN own AND rs > ls THEN split ELSE cx END AS kx, CASE WHEN own AND rs <= ls THEN split ELSE cx + cw END AS kr, CASE WHEN NOT own THEN cb WHEN rs > ls THEN rb ELSE lb END AS kb, CASE WHEN bottom > b THEN least(0.985, bottom) END AS hard FROM b3),
    b5 AS (SELECT *, kr - kx AS kw, bottom IS NULL AND hard IS NULL AS free, b - y AS h FROM b4),
    b6 AS (SELECT *, least(greatest(h, 0.20, mh * 8, kw * 0.30), 0.38) AS t_least, least(greatest(h, 0.12, mh * 5, kw * 0.20), 0.28) AS n_least FROM b5),
    b7 AS (SELECT *, CASE WHEN hard IS NULL THEN greatest(b, y + CASE WHEN free THEN t_least ELSE n_least END) ELSE least(hard, greatest(b, hard, y + n_least)) END AS reach, least(0.985, greatest(kb, b + greatest(0.07, mh * 3.5), y + t_least)) AS terminal,
        CASE WHEN w < kw * 0.92 THEN kx ELSE greatest(kx, x - least(0.02, kw * 0.035)) END AS gx, CASE WHEN w < kw * 0.92 THEN kr ELSE least(kr, r + least(0.02, kw * 0.035)) END AS gr FROM b6),
    b8 AS (SELECT *, least(0.985, CASE WHEN free THEN least(greatest(reach, terminal), y + greatest(h, least(greatest(0.42, mh * 14), 0.56))) ELSE reach END) AS gb FROM b7),
    z AS (SELECT page, text, confidence, greatest(0, gx - 0.012) AS x0, greatest(0, y - 0.012) AS y0, least(1, gr + 0.012) AS x1, least(1, gb + 0.012) AS y1 FROM b8),
    banded AS (SELECT *, y0 - lag(y0) OVER (PARTITION BY page ORDER BY y0, x0) > 0.04 AS new FROM z WHERE (x1 - x0) * (y1 - y0) >= 0.012 AND text <> ''),
    ordered AS (SELECT *, sum(coalesce(new, false)::INT) OVER (PARTITION BY page ORDER BY y0, x0) AS band FROM banded)
    SELECT page, row_number() OVER (PARTITION BY page ORDER BY band, x0, y0)::INTEGER AS index, round(x0, 9) AS x, round(y0, 9) AS y, round(x1 - x0, 9) AS w, round(y1 - y0, 9) AS h, text, round(confidence, 9) AS confidence FROM ordered"""


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", r"\.\s*")).alias("i", "t"))
    docs = docs.select("*", F.length("t").alias("size"))
    n, j, size = F.col("doc_id"), F.col("i") % 12, F.col("size")
    single = n % 2 == 0
    return docs.select(
        F.concat_ws(":", n.cast("string"), F.expr("i div 12").cast("string")).alias("page"), F.when(single, 0.1).when(F.col("i") % 2 == 0, 0.06).otherwise(0.54).alias("x"),
        (0.02 + 0.075 * j + 0.0041 * (size % 7) + F.when(j >= 6, 0.05).otherwise(0.0)).alias("y"), F.when(single, 0.5 + 0.03 * (size % 10)).otherwise(0.25 + 0.01 * (size % 10)).alias("w"), (0.0213 + 0.0047 * (size % 3)).alias("h"),
        F.when((n % 3 > 0) & (F.col("i") % 3 == 1), F.concat(F.col("i").cast("string"), F.lit(". "), F.col("t"))).otherwise(F.col("t")).alias("text"), (0.9 - 0.01 * j).alias("confidence"),
    )


def rounded_regions(found: DataFrame) -> DataFrame:
    return found.select("page", "index", *[F.round(c, 9).alias(c) for c in ("x", "y", "w", "h")], "text", F.round("confidence", 9).alias("confidence"))


@query("WITH " + regions_sql(False))
def q8_regions(spark, sf_dir):
    """Question crops of every sentence."""
    return rounded_regions(layout.regions(page_lines(spark, sf_dir)))


@query("WITH " + regions_sql(True))
def q8_regions_by_column(spark, sf_dir):
    """Q8 where the lines of two columns are not mixed."""
    return rounded_regions(layout.regions(page_lines(spark, sf_dir), by_column=True))


# Two quadrilaterals for each order, whose corners follow from its numbers; regions stand in the middle of the page.
QUADS_SQL = """c AS (SELECT o_orderkey AS page, k, ((o_orderkey * (k + 3)) % 7) / 10.0::DOUBLE AS confidence, (o_orderkey % 11) * 0.02::DOUBLE AS a, (o_custkey % 13) * 0.02::DOUBLE AS b, (o_orderkey % 5) * 0.06 * k::DOUBLE AS d FROM orders, (SELECT unnest([0, 1]) AS k)),
    q0 AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY confidence DESC, k) AS n FROM c),
    q AS (SELECT page, [a, 1 - b, 1 - a * 0.5, b + d] AS x, [b * 0.5, a, 1 - b - d, 1 - a] AS y FROM q0 WHERE n = 1),
    t AS (SELECT *, abs((x[1] * y[2] - x[2] * y[1]) + (x[2] * y[3] - x[3] * y[2]) + (x[3] * y[4] - x[4] * y[3]) + (x[4] * y[1] - x[1] * y[4])) / 2 AS area, (list_max(x) - list_min(x)) * (list_max(y) - list_min(y)) AS around,
        list_transform([1, 2, 3, 4], lambda i: degrees(acos(greatest(-1, least(1, ((x[(i + 2) % 4 + 1] - x[i]) * (x[i % 4 + 1] - x[i]) + (y[(i + 2) % 4 + 1] - y[i]) * (y[i % 4 + 1] - y[i]))
          / (sqrt((x[(i + 2) % 4 + 1] - x[i]) ** 2 + (y[(i + 2) % 4 + 1] - y[i]) ** 2) * sqrt((x[i % 4 + 1] - x[i]) ** 2 + (y[i % 4 + 1] - y[i]) ** 2))))))) AS angles FROM q),
    w AS (SELECT *, coalesce(area >= 0.35 AND area / around <= 0.97 AND list_min(angles) >= 50 AND list_max(angles) <= 135, false) AS ok FROM t),
    m AS (SELECT page, ok, list_transform([[0.1, 0.2], [0.1, 0.6], [0.7, 0.2], [0.7, 0.6]], lambda p: (1 - p[1]) * (1 - p[2]) * x[1] + p[1] * (1 - p[2]) * x[2] + p[1] * p[2] * x[3] + (1 - p[1]) * p[2] * x[4]) AS xs,
        list_transform([[0.1, 0.2], [0.1, 0.6], [0.7, 0.2], [0.7, 0.6]], lambda p: (1 - p[1]) * (1 - p[2]) * y[1] + p[1] * (1 - p[2]) * y[2] + p[1] * p[2] * y[3] + (1 - p[1]) * p[2] * y[4]) AS ys FROM w),
    e AS (SELECT page, ok, CASE WHEN ok THEN greatest(0, list_min(xs) - 0.004) ELSE 0.1 END AS x0, CASE WHEN ok THEN greatest(0, list_min(ys) - 0.004) ELSE 0.2 END AS y0, CASE WHEN ok THEN least(1, list_max(xs) + 0.004) ELSE 0.7 END AS x1, CASE WHEN ok THEN least(1, list_max(ys) + 0.004) ELSE 0.6 END AS y1 FROM m)"""


@query(f"WITH {QUADS_SQL} SELECT page, round(x0, 9) AS x, round(y0, 9) AS y, round(x1 - x0, 9) AS w, round(y1 - y0, 9) AS h, ok AS straightened FROM e WHERE NOT ok OR (x1 - x0) * (y1 - y0) >= 0.006")
def f25_straightened(spark, sf_dir):
    """The quadrilateral that a page is set straight by, and a region mapped back by it."""
    o, n, m = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    a, b = (n % 11) * 0.02, (m % 13) * 0.02

    def candidate(k):
        d = (n % 5) * 0.06 * k
        corners = [(a, b * 0.5), (1 - b, a), (1 - a * 0.5, 1 - b - d), (b + d, 1 - a)]
        return F.struct(((n * (k + 3)) % 7 / F.lit(10.0)).alias("confidence"), F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in corners]).alias("quad"))

    pages = o.select(n.alias("page"), F.array(candidate(0), candidate(1)).alias("candidates"))
    regions = o.select(n.alias("page"), F.lit(0.1).alias("x"), F.lit(0.2).alias("y"), F.lit(0.6).alias("w"), F.lit(0.4).alias("h"))
    return layout.straightened_regions(regions, pages).select("page", *[F.round(c, 9).alias(c) for c in ("x", "y", "w", "h")], "straightened")


@query("""SELECT user_id, CASE WHEN a = 0 AND u = 0 THEN '已更新你的学习档案' ELSE concat_ws(' · ', CASE WHEN a > 0 THEN '新增 ' || a || ' 条' END, CASE WHEN u > 0 THEN '更新 ' || u || ' 条' END) END AS line
    FROM (SELECT user_id, count(*) FILTER (event_type <> 'click') AS a, count(*) FILTER (event_type = 'click') AS u FROM events GROUP BY user_id)""")
def f38_delta_line(spark, sf_dir):
    return a4_deltas(spark, sf_dir).select("user_id", intent.delta_line(F.col("adds"), F.col("updates")).alias("line"))


@query("""WITH r AS (SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'preference' ELSE 'context_toggle' END AS category, value, event_id % 5 AS k, event_type FROM events WHERE value >= 30 AND event_id % 3 < 2)
    SELECT id, category, CASE WHEN category = 'preference' THEN '辅导偏好' WHEN k = 0 THEN '画面' WHEN k = 1 THEN '长期记忆' ELSE '调试' END AS label,
      CASE WHEN category = 'preference' THEN '（默认）' WHEN k = 1 THEN '开' ELSE '未知' END AS before, CASE WHEN category = 'preference' THEN event_type WHEN value > 50 THEN '开' ELSE '关' END AS after,
      category = 'preference' OR k = 1 AS reversible FROM r WHERE category = 'preference' OR k < 3""")
def q11_proposals(spark, sf_dir):
    """Requests made from events by rule."""
    e = table(spark, sf_dir, "events")
    wanted = F.element_at(F.array(F.lit("update_coach_preference"), F.lit("toggle_context"), F.lit("dance")), (F.col("event_id") % 3 + 1).cast("int"))
    keys = F.element_at(F.array(*map(F.lit, ("visual", "memory", "debug", "other", ""))), (F.col("event_id") % 5 + 1).cast("int"))
    requests = e.select(F.col("event_id").alias("id"), wanted.alias("intent"), (F.col("value") / 50).alias("confidence"), F.col("event_type").alias("text"), F.lit("append").alias("mode"), keys.alias("key"), (F.col("value") > 50).alias("value"), F.lit("").alias("preference"), F.create_map(F.lit("memory"), F.lit(True)).alias("included"))
    return intent.proposals(requests).select("id", "category", "change.label", "change.before", "change.after", "reversible")


# Six events in a row are the commands of a proposal.
COMMANDS_SQL = """c AS (SELECT event_id // 6 AS id, event_id AS seq, ts AS "at", CASE event_id % 6 WHEN 0 THEN 'propose' WHEN 1 THEN 'confirm' WHEN 5 THEN CASE WHEN value > 80 THEN 'propose' ELSE 'confirm' END ELSE 'undo' END AS command,
        CASE WHEN value > 90 THEN 'b' ELSE 'a' END AS account, CASE event_id // 6 % 4 WHEN 0 THEN 'preference' WHEN 3 THEN 'other' ELSE 'context_toggle' END AS category, event_id // 6 % 5 > 0 AS reversible,
        CASE WHEN event_id // 6 % 4 = 0 THEN MAP {'coach_preference_text': event_type} ELSE MAP {'memory': 'true', 'visual': 'false'} END AS applied,
        CASE WHEN value < 15 THEN NULL WHEN event_id // 6 % 4 = 0 THEN MAP {'coach_preference_text': CASE WHEN value < 60 THEN (SELECT any_value(e.event_type) FROM events e WHERE e.event_id = events.event_id // 6 * 6) ELSE 'x' END}
          WHEN value < 25 THEN MAP {'memory': 'true'} ELSE MAP {'memory': 'true', 'visual': CASE WHEN value < 60 THEN 'false' ELSE 'true' END} END AS current FROM events),
    o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY "at", seq) AS k FROM c)"""


@query(f"""WITH RECURSIVE {COMMANDS_SQL},
    walk AS (SELECT id, 0::BIGINT AS k, NULL::BIGINT AS seq, NULL::VARCHAR AS command, NULL::TIMESTAMP AS "at", 'none' AS phase, NULL::TIMESTAMP AS since, NULL::VARCHAR AS account, NULL::VARCHAR AS category, false AS reversible, NULL::MAP(VARCHAR, VARCHAR) AS applied, NULL::VARCHAR AS answer FROM o WHERE k = 1
        UNION ALL SELECT id, k, seq, command, "at", CASE WHEN command = 'propose' OR answer IN ('confirmed', 'undone') THEN answer ELSE phase END, CASE WHEN command = 'propose' OR answer IN ('confirmed', 'undone') THEN "at" ELSE since END,
            CASE WHEN command = 'propose' THEN by_ ELSE account END, CASE WHEN command = 'propose' THEN new_category ELSE category END, CASE WHEN command = 'propose' THEN new_reversible ELSE reversible END, CASE WHEN command = 'propose' THEN new_applied ELSE applied END, answer
          FROM (SELECT *, CASE WHEN command = 'propose' THEN 'pending' WHEN phase = 'none' THEN 'not found' WHEN account <> by_ THEN 'forbidden' WHEN command = 'confirm' THEN CASE WHEN phase = 'pending' THEN 'confirmed' ELSE 'not pending' END
              WHEN phase <> 'confirmed' THEN 'not confirmed' WHEN NOT reversible THEN 'not undoable' WHEN current IS NULL THEN 'unverifiable' WHEN category = 'other' THEN 'unsupported'
              WHEN len(odd) = 0 THEN 'undone' WHEN list_contains(map_keys(current), odd[1]) THEN 'drifted' ELSE 'unverifiable' END AS answer
            FROM (SELECT w.* EXCLUDE (k, seq, command, "at", answer, phase), o.k, o.seq, o.command, o."at", o.account AS by_, o.category AS new_category, o.reversible AS new_reversible, o.applied AS new_applied, o.current,
                CASE WHEN epoch_us(o."at") - epoch_us(w.since) <= CASE w.phase WHEN 'pending' THEN 600 WHEN 'confirmed' THEN 86400 WHEN 'undone' THEN 60 ELSE -1 END * 1000000::BIGINT THEN w.phase ELSE 'none' END AS phase,
                list_filter(map_keys(w.applied), lambda x: coalesce(o.current[x], '?') <> w.applied[x]) AS odd
              FROM walk w JOIN o ON o.id = w.id AND o.k = w.k + 1)))
    SELECT id, seq, command, "at", answer FROM walk WHERE k > 0""")
def q11_history(spark, sf_dir):
    """Q11 X2 X3 over history: events stand for commands."""
    e = table(spark, sf_dir, "events")
    n, step, text = F.floor(F.col("event_id") / 6), F.col("event_id") % 6, lambda *kv: F.create_map(*map(F.lit, kv))
    commands = e.select(
        n.alias("id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"), F.when(step == 0, "propose").when(step == 1, "confirm").when(step == 5, F.when(F.col("value") > 80, "propose").otherwise("confirm")).otherwise("undo").alias("command"),
        F.when(F.col("value") > 90, "b").otherwise("a").alias("account"), F.when(n % 4 == 0, "preference").when(n % 4 == 3, "other").otherwise("context_toggle").alias("category"), (n % 5 > 0).alias("reversible"), "event_type", "value",
    )
    told = commands.where("seq % 6 = 0").select("id", F.col("event_type").alias("first_type"))
    preference = F.col("id") % 4 == 0
    applied = F.when(preference, F.create_map(F.lit(intent.PREFERENCE_KEY), F.col("event_type"))).otherwise(text("memory", "true", "visual", "false"))
    switched = F.when(F.col("value") < 25, text("memory", "true")).when(F.col("value") < 60, text("memory", "true", "visual", "false")).otherwise(text("memory", "true", "visual", "true"))
    current = F.when(F.col("value") < 15, None).when(preference, F.create_map(F.lit(intent.PREFERENCE_KEY), F.when(F.col("value") < 60, F.col("first_type")).otherwise(F.lit("x")))).otherwise(switched)
    return intent.proposal_history(commands.join(told, "id", "left").withColumns({"applied": applied, "current": current})).select("id", "seq", "command", F.col("at").cast("timestamp_ntz").alias("at"), "answer")


@query("""WITH b AS (SELECT event_id, user_id, value, arg_max({'event_id': event_id, 'value': value}, (value, -event_id)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM events)
    SELECT event_id, p.event_id AS best_previous, p.value AS best_score FROM b""")
def j12_best_previous(spark, sf_dir):
    """Each event against the best before it."""
    return matching.best_previous(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), ["user_id"], "event_id", "value").select("event_id", "best_previous", "best_score")


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) WHEN 2 THEN date_trunc('second', ts) - INTERVAL 2 HOUR WHEN 3 THEN date_trunc('day', ts) END AS at FROM events""")
def f7_times(spark, sf_dir):
    """times as texts with and without a zone, days, and what is none."""
    n, ts = F.col("event_id") % 6, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    told = F.when(n == 0, F.concat(ts, F.lit("Z"))).when(n == 1, ts).when(n == 2, F.concat(ts, F.lit("+02:00"))).when(n == 3, F.date_format("ts", "yyyy-MM-dd")).when(n == 4, F.concat(F.lit("at "), ts))
    return table(spark, sf_dir, "events").select("event_id", scoring.iso_time(told).cast("timestamp_ntz").alias("at"))


@query("""WITH e AS (SELECT event_id, unnest([0, 1, 2, 3, 4]) AS seq, value, event_type FROM events WHERE event_id % 4 < 3)
    SELECT event_id, CASE WHEN seq = 3 THEN 2 ELSE seq END AS seq, CASE seq WHEN 0 THEN 'likes ' || event_type WHEN 1 THEN 'short' ELSE 'last' END AS text, CASE WHEN seq = 0 THEN 'goal' ELSE 'fact' END AS kind, CASE seq WHEN 0 THEN greatest(0, least(1, value / 100)) WHEN 1 THEN 0.5 ELSE 1 END::DOUBLE AS importance
    FROM e WHERE seq IN (0, 1) OR (seq = 3 AND event_id % 4 = 2)""")
def p18_candidates(spark, sf_dir):
    """Facts in replies that events stand for: fenced, amid prose, with entries that are no facts."""
    e, n = table(spark, sf_dir, "events"), F.col("event_id") % 4
    items = F.concat(F.lit('[{"text": " likes '), F.col("event_type"), F.lit('", "kind": " Goal", "importance": '), F.col("value").cast("decimal(20,10)") / 100, F.lit('}, {"text": "short", "kind": "wish", "importance": "x"}'))
    more = F.when(n == 2, F.lit(', {"text": "last", "importance": 7}, 3, {"text": "abc"}')).otherwise(F.lit(', "none", {"text": null}'))
    reply = F.concat(items, more, F.lit("]"))
    told = F.when(n == 0, reply).when(n == 1, F.concat(F.lit("```json\n"), reply, F.lit("\n```"))).when(n == 2, F.concat(F.lit("noted: "), reply, F.lit(" ok"))).otherwise(F.lit("[broken"))
    return memory.candidates(e.select("event_id", told.alias("reply"))).select("event_id", "seq", "text", "kind", "importance")


@query("""SELECT doc_id, left(regexp_replace(t, '[^A-Za-z0-9_.-]', '_', 'g'), 120) AS safe FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE lang || '/' || source || ' é.' || repeat('x', (doc_id % 200)::INT) END AS t FROM documents) WHERE t <> ''
    UNION ALL SELECT doc_id, 'local' FROM documents WHERE doc_id % 5 = 0""")
def f12_safe_ids(spark, sf_dir):
    n = F.col("doc_id")
    told = F.when(n % 5 == 0, "").otherwise(F.concat("lang", F.lit("/"), "source", F.lit(" é."), F.repeat(F.lit("x"), (n % 200).cast("int"))))
    return table(spark, sf_dir, "documents").select("doc_id", text.safe_id(told).alias("safe"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Dear ' || o_clerk || ', ' || o_orderstatus || '.' WHEN 1 THEN o_clerk || ' has ' ELSE 'for ' || o_clerk END AS note FROM (SELECT *, 'c' || o_custkey AS o_clerk FROM orders)""")
def f16_rendered(spark, sf_dir):
    """Templates filled in; one with a name that it may not use gives way to the default."""
    o, n = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 3
    template = F.when(n == 0, "Dear {who}, {status}.").when(n == 1, "{who} has {none}").otherwise("{secret} of {who}")
    values = {"who": F.concat(F.lit("c"), F.col("o_custkey").cast("string")), "status": F.col("o_orderstatus"), "none": F.lit(None).cast("string")}
    return o.select("o_orderkey", text.render(template, values, F.lit("for {who}")).alias("note"))


BOXES_SQL = """r AS (SELECT l_orderkey, l_linenumber, l_quantity / 40 - 0.1 AS x, l_discount * 8 AS y, 0.3 + l_tax AS w, 0.25::DOUBLE AS h FROM lineitem),
    c AS (SELECT *, least(greatest(x, 0), 1) AS x0, least(greatest(y, 0), 1) AS y0, least(greatest(x + w, 0), 1) AS x1, least(greatest(y + h, 0), 1) AS y1 FROM r)"""


@query(f"""WITH {BOXES_SQL} SELECT l_orderkey, l_linenumber, round(x1 - x0, 6) AS w, round(y1 - y0, 6) AS h, round(greatest(0, least(x1, 0.6) - greatest(x0, 0.2)) * greatest(0, least(y1, 0.7) - greatest(y0, 0.3)), 6) AS shared,
    round((greatest(x1, 0.6) - least(x0, 0.2)) * (greatest(y1, 0.7) - least(y0, 0.3)), 6) AS around, round(least(greatest(x + w / 2 - 0.25, 0.025), 0.975 - 0.5), 6) AS low FROM c""")
def f24_boxes(spark, sf_dir):
    """Rectangles of line items, cut, met and joined with another, and spans moved into bounds."""
    from lodestone.functions import geometry as g

    x, y, w = F.col("l_quantity") / 40 - 0.1, F.col("l_discount") * 8, F.col("l_tax") + 0.3
    own, other = g.clamp(g.rect(x, y, w, F.lit(0.25))), g.rect(F.lit(0.2), F.lit(0.3), F.lit(0.4), F.lit(0.4))
    both = g.union(own, other)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(own["w"], 6).alias("w"), F.round(own["h"], 6).alias("h"), F.round(g.overlap(own, other), 6).alias("shared"), F.round(both["w"] * both["h"], 6).alias("around"), F.round(g.bounded(x + w / 2, F.lit(0.5), 0.025, 0.975)["low"], 6).alias("low"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS n, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN '7' END AS first FROM events""")
def f32_lists(spark, sf_dir):
    n = F.col("event_id") % 4
    told = F.when(n == 0, F.concat(F.lit('["'), "event_type", F.lit('", "b"]'))).when(n == 1, "[7]").when(n == 2, "[broken")
    items = text.list_or_empty(told)
    return table(spark, sf_dir, "events").select("event_id", F.size(items).alias("n"), F.get(items, F.lit(0)).alias("first"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'p. 3' WHEN 1 THEN 'page ' || o_custkey || ' no. ' || o_orderkey WHEN 2 THEN 'no. ' || o_orderkey ELSE '' END AS place FROM orders""")
def f34_locations(spark, sf_dir):
    n = F.col("o_orderkey") % 4
    page, question = (F.concat(F.lit(w), F.col(c).cast("string")) for w, c in (("page ", "o_custkey"), ("no. ", "o_orderkey")))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.location(F.when(n == 0, "p. 3").otherwise(""), F.when(n == 1, page), F.when(n < 3, question)).alias("place"))


@query("""SELECT doc_id, doc_id % 6 IN (0, 3, 4) AS asks, (doc_id % 2 = 0 AND (length(text) >= 50 OR doc_id % 7 = 0)) AS actionable FROM documents""")
def f35_signals(spark, sf_dir):
    """Documents with words of a settings request put before them by rule."""
    n = F.col("doc_id")
    word = F.element_at(F.array(*map(F.lit, ("以后", "打开", "记忆", "打开历史", "讲题", "abc"))), (n % 6 + 1).cast("int"))
    docs = table(spark, sf_dir, "documents").withColumn("t", F.concat(word, F.lit(" "), F.coalesce("text", F.lit(""))))
    return docs.select("doc_id", text.looks_like_settings(F.col("t")).alias("asks"), text.actionable(n % 2 == 0, n % 7 == 0, F.col("text")).alias("actionable"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN 'uncertain' WHEN l_linestatus = 'F' THEN 'correct' ELSE 'uncertain' END AS mark,
    CASE WHEN l_linenumber = 1 AND l_returnflag = 'R' THEN 0 WHEN l_linenumber = 2 THEN 3 WHEN l_linenumber = 3 THEN 1 WHEN l_linenumber = 4 THEN 12 ELSE 4 END AS lines FROM lineitem""")
def f36_marks(spark, sf_dir):
    """Marks of graded questions, and lines for answers."""
    n, r = F.col("l_linenumber"), F.col("l_returnflag")
    kind = F.when(n == 1, "选择题").when(n == 3, "口算题").when(n == 4, "作文题").otherwise("other")
    options = F.when(r == "R", F.array(F.lit("A"))).otherwise(F.array().cast("array<string>"))
    mark = labels.grade_mark(r != "N", F.when(F.col("l_linestatus") == "F", "correct").otherwise("odd"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", mark.alias("mark"), labels.answer_lines(kind, options, F.when(n == 2, 3)).cast("int").alias("lines"))


@query("""SELECT c_custkey, 'ip_' || s || '_t' || c_custkey AS id, s AS owner FROM (SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'local' ELSE regexp_replace(c_name || '/' || c_mktsegment, '[^a-zA-Z0-9_-]', '_', 'g') END AS s FROM customer)
    UNION ALL SELECT c_custkey, c_name, '' FROM customer""")
def f39_owners(spark, sf_dir):
    """ids of proposals made and read, and ids that are none."""
    c = table(spark, sf_dir, "customer")
    made = c.select("c_custkey", text.proposal_id(F.when(F.col("c_custkey") % 9 > 0, F.concat("c_name", F.lit("/"), "c_mktsegment")), F.concat(F.lit("t"), F.col("c_custkey").cast("string"))).alias("id"))
    return made.unionByName(c.select("c_custkey", F.col("c_name").alias("id"))).withColumn("owner", text.owner_of(F.col("id")))


@query("""SELECT l_orderkey AS page, l_linenumber AS index, l_quantity, CASE WHEN o_orderpriority IS NOT NULL THEN o_orderstatus END AS verdict FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND l_linenumber = o_orderkey % 3 + 1""")
def j10_graded(spark, sf_dir):
    """Line items stand for regions, each order has a grade for one of them."""
    regions = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("index"), "l_quantity")
    grades = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), (F.col("o_orderkey") % 3 + 1).alias("index"), F.col("o_orderstatus").alias("verdict"))
    return matching.graded_regions(regions, grades).select("page", "index", "l_quantity", "verdict")


@query(f"""WITH {FACTS_SQL} SELECT id, CASE WHEN id % 3 = 0 THEN 'corrected ' || id ELSE text END AS text, round(CASE WHEN id % 3 = 0 THEN -e[1] ELSE e[1] END, 6) AS first, CASE WHEN id % 3 = 0 THEN 0 ELSE age END AS age FROM facts""")
def m5_corrected(spark, sf_dir):
    """M5: corrected texts with their vectors."""
    f = facts(spark, sf_dir).withColumn("embedding", F.col("embedding").cast("array<double>"))
    better = f.where("id % 3 = 0").select("id", F.concat(F.lit("corrected "), F.col("id").cast("string")).alias("text"), F.transform("embedding", lambda x: -x).alias("embedding"))
    now = F.expr(NOW)
    return state.replace_text(f, better, now).select("id", "text", F.round(F.get("embedding", F.lit(0)), 6).alias("first"), scoring.age_days(F.col("updated_at"), now).alias("age"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = (SELECT min(c_mktsegment) FROM customer) UNION ALL SELECT c_custkey + 1000000, c_mktsegment FROM customer WHERE c_mktsegment = (SELECT min(c_mktsegment) FROM customer)")
def s1_shard(spark, sf_dir):
    """Customers kept in a folder for each segment, appended to, and one segment read again."""
    import uuid

    from lodestone.operators.shared import shared_dir
    from lodestone.sources import shards

    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    root = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    shards.write_shards(c, root, "c_mktsegment")
    shards.write_shards(c.withColumn("c_custkey", F.col("c_custkey") + 1000000), root, "c_mktsegment")
    one = c.agg(F.min("c_mktsegment")).first()[0]
    return shards.read_shard(spark, root, one, "c_mktsegment").select("c_custkey", "c_mktsegment")


@query("""SELECT account_id, scope, max(n) AS n FROM (SELECT CASE WHEN c_custkey % 5 = 0 THEN 'local' ELSE c_mktsegment END AS account_id, CASE WHEN c_custkey % 3 = 0 THEN 'global' ELSE 's' || c_nationkey END AS scope, c_custkey AS n FROM customer) GROUP BY ALL""")
def s6_rekeyed(spark, sf_dir):
    """Profiles under a new key, the latest of those that clash."""
    from lodestone.sources.shards import rekeyed

    n = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(F.when(n % 5 > 0, F.col("c_mktsegment")).otherwise("").alias("account_id"), F.when(n % 3 > 0, F.concat(F.lit("s"), F.col("c_nationkey").cast("string"))).alias("scope"), n.alias("n"), n.alias("updated_at"))
    return rekeyed(rows).select("account_id", "scope", "n")


@query("""SELECT event_id, p AS part, p + 1 AS sequence_index, 'p' || event_id AS page_hint, CASE WHEN p = 1 THEN event_type END AS source FROM (SELECT event_id, event_type, unnest(range(event_id % 3))::INTEGER AS p FROM events)""")
def s12_captures(spark, sf_dir):
    """The captures that a batch's JSON lists; broken lists have none."""
    from lodestone.sources.shards import capture_rows

    n, e = F.col("event_id") % 3, F.col("event_id").cast("string")
    one = lambda i, tail="": F.concat(F.lit(f'{{"sequence_index": {i}, "page_hint": "p'), e, F.lit('"'), F.lit(tail))
    second = F.concat(one(2), F.lit(', "source": "'), F.col("event_type"), F.lit('"}'))
    told = F.when(n == 0, "[]").when(n == 1, F.concat(F.lit("["), one(1, "}"), F.lit("]"))).otherwise(F.concat(F.lit("["), one(1, "}"), F.lit(", "), second, F.lit("]")))
    return capture_rows(table(spark, sf_dir, "events").select("event_id", told.alias("capture_meta"))).select("event_id", "part", "sequence_index", "page_hint", "source")


@query("""SELECT to_json({'c_custkey': c_custkey, 'c_name': c_name})::VARCHAR AS value FROM customer""")
def s13_json(spark, sf_dir):
    from lodestone.sources.shards import json_rows

    return json_rows(table(spark, sf_dir, "customer").select("c_custkey", "c_name"))


@query("""SELECT event_id, ts FROM events WHERE event_id % 4 = 0 OR ts > TIMESTAMP '2024-01-15 00:00:00'""")
def x7_live(spark, sf_dir):
    """Commands that have not expired; those without a time never do."""
    from lodestone.streaming.feeds import live

    e = table(spark, sf_dir, "events").withColumn("expires_at", F.when(F.col("event_id") % 4 > 0, F.col("ts")))
    return live(e, F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'")).select("event_id", "ts")
