"""Sources, publication, splits and text slots."""

from __future__ import annotations

from pyspark.sql import functions as F

from earshot.functions import scalars
from earshot.operators import splits
from earshot.plans.registry import query, table
from earshot.session import pin
from earshot.sources import ingest, publish

SEED = 11
RATE = 16
CAP = ingest.budget_cap(0.5, RATE)
HELD_OUT = 7
QUOTAS = {"train": 9000, "val": 1200}

TAGS_SQL = """CASE doc_id % 5 WHEN 0 THEN ['Music', 'Guitar'] WHEN 1 THEN ['Speech', 'Male']
  WHEN 2 THEN ['Wind', 'Speech synthesizer'] WHEN 3 THEN ['Rain'] END"""
ROLE_SQL = "CASE lang WHEN 'en' THEN 'speech' WHEN 'fr' THEN 'music' ELSE 'env' END"
ALLOWED_SQL = """coalesce(CASE role WHEN 'music' THEN contains(tags, 'music')
  WHEN 'env' THEN NOT contains(tags, 'music') AND NOT contains(tags, 'speech')
  ELSE contains(tags, 'speech') END, true)"""
CLIPS_SQL = f"""
clips AS (
  SELECT *, {ALLOWED_SQL} AS allowed FROM (
    SELECT doc_id, source, {ROLE_SQL} AS role,
           lower(array_to_string({TAGS_SQL}, ' ')) AS tags,
           source || '_' || (n_chars % 97) AS stem,
           CASE WHEN n_chars % 13 <> 0 THEN n_chars END AS n_samples
    FROM documents)),
firsts AS (
  SELECT role, stem, arg_min(n_samples, (source, doc_id)) AS first_samples,
         arg_min(doc_id, (source, doc_id)) AS first_doc, min((source, doc_id)) AS first_place
  FROM clips WHERE allowed AND n_samples IS NOT NULL GROUP BY ALL),
scan AS (
  SELECT c.*, CASE WHEN allowed AND (source, doc_id) >= first_place THEN first_samples ELSE 0 END AS counted,
         coalesce(allowed AND n_samples IS NOT NULL AND first_doc = doc_id, false) AS stored
  FROM clips c LEFT JOIN firsts USING (role, stem)),
met AS (
  SELECT * FROM (
    SELECT *, CAST(coalesce(sum(counted) OVER (PARTITION BY role ORDER BY source, doc_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
    FROM scan) WHERE before < {CAP})"""


def tags():
    return (
        F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("Music"), F.lit("Guitar")))
        .when(F.col("doc_id") % 5 == 1, F.array(F.lit("Speech"), F.lit("Male")))
        .when(F.col("doc_id") % 5 == 2, F.array(F.lit("Wind"), F.lit("Speech synthesizer")))
        .when(F.col("doc_id") % 5 == 3, F.array(F.lit("Rain")))
    )


def role_of():
    return (
        F.when(F.col("lang") == "en", "speech").when(F.col("lang") == "fr", "music")
        .otherwise("env")
    )


def met_clips(spark, sf_dir):
    clips = table(spark, sf_dir, "documents").select(
        "doc_id", "source", role_of().alias("role"),
        F.concat_ws("_", "source", F.col("n_chars") % 97).alias("stem"),
        F.when(F.col("n_chars") % 13 != 0, F.col("n_chars")).alias("n_samples"),
        ingest.label_allows(role_of(), tags()).alias("allowed"),
    )
    return ingest.budgeted_ingest(clips, ["source", "doc_id"], CAP)


@query("src1_parse_sources", """
WITH entries AS (
  SELECT url AS entry FROM pages UNION ALL
  SELECT CASE lang WHEN 'en' THEN 'speech=' WHEN 'fr' THEN 'music=' WHEN 'de' THEN 'noise=' ELSE '' END
         || source || '::' || doc_id || '=x' FROM documents),
cut AS (SELECT entry, strpos(entry, '=') AS eq FROM entries)
SELECT entry,
       CASE WHEN eq > 0 AND substr(entry, 1, eq - 1) IN ('speech', 'music', 'env')
            THEN substr(entry, 1, eq - 1) ELSE 'env' END AS role,
       CASE WHEN eq > 0 AND substr(entry, 1, eq - 1) IN ('speech', 'music', 'env')
            THEN substr(entry, eq + 1) ELSE entry END AS source
FROM cut""")
def parse_sources(spark, sf_dir):
    tag = (
        F.when(F.col("lang") == "en", "speech=").when(F.col("lang") == "fr", "music=")
        .when(F.col("lang") == "de", "noise=").otherwise("")
    )
    named = table(spark, sf_dir, "documents").select(
        F.concat(tag, F.col("source"), F.lit("::"), F.col("doc_id"), F.lit("=x")).alias("entry")
    )
    urls = table(spark, sf_dir, "pages").select(F.col("url").alias("entry"))
    return ingest.parse_sources(urls.unionByName(named))


@query("src2_optional_labels", f"""
SELECT doc_id AS id, array_to_string({TAGS_SQL}, ' ') AS tags, n_chars AS length FROM documents
UNION ALL SELECT page_id, NULL, length(html) FROM pages""")
def optional_labels(spark, sf_dir):
    labelled = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("n_chars").alias("length"),
        tags().alias("human_labels"),
    )
    bare = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("id"), F.length("html").cast("long").alias("length")
    )
    rows = ingest.with_labels(labelled).unionByName(ingest.with_labels(bare))
    return rows.select("id", "length", F.array_join("human_labels", " ").alias("tags"))


@query("src3_label_role", f"""
WITH r AS (SELECT doc_id, role, lower(array_to_string({TAGS_SQL}, ' ')) AS tags
           FROM documents CROSS JOIN (VALUES ('speech'), ('music'), ('env')) v(role))
SELECT doc_id, role, {ALLOWED_SQL} AS allowed FROM r""")
def label_role(spark, sf_dir):
    roles = F.array(F.lit("speech"), F.lit("music"), F.lit("env"))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", tags().alias("tags"), F.explode(roles).alias("role")
    )
    return rows.select(
        "doc_id", "role", ingest.label_allows(F.col("role"), F.col("tags")).alias("allowed")
    )


@query("src5_budgeted_ingest", f"WITH {CLIPS_SQL} SELECT doc_id, role, before, allowed AS kept FROM met")
def budgeted_ingest(spark, sf_dir):
    return met_clips(spark, sf_dir).select("doc_id", "role", "before", "kept")


@query("src6_storage_keys", f"WITH {CLIPS_SQL} SELECT role, stem, doc_id, n_samples FROM met WHERE stored")
def storage_keys(spark, sf_dir):
    return met_clips(spark, sf_dir).where("stored").select("role", "stem", "doc_id", "n_samples")


@query("src7_ingest_report", f"""WITH {CLIPS_SQL}
SELECT role, CAST(sum(counted) AS BIGINT) AS samples, round(sum(counted) / {RATE} / 3600, 2) AS hours,
       count(*) FILTER (allowed) AS rows_kept, count(*) FILTER (NOT allowed) AS dropped_by_label
FROM met GROUP BY role""")
def ingest_report(spark, sf_dir):
    asked = spark.createDataFrame([("speech",), ("music",), ("env",)], "role string")
    return ingest.require_audio(ingest.ingest_report(met_clips(spark, sf_dir), RATE), asked)


@query("src8_clip_seconds", """
SELECT l_orderkey, l_linenumber, round(coalesce(l_partkey / nullif(l_discount, 0), 0.0), 6) AS seconds
FROM lineitem""")
def clip_seconds(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.round(scalars.clip_seconds("l_partkey", "l_discount"), 6).alias("seconds"),
    )


@query("snk1_publish_read_back", """
SELECT page_id || '.html' AS name, CAST(octet_length(encode(html)) AS BIGINT) AS length,
       sha256(html) AS sha256, true AS same FROM pages""")
def publish_read_back(spark, sf_dir):
    artifacts = table(spark, sf_dir, "pages").select(
        F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("name"),
        F.encode("html", "UTF-8").alias("content"),
    )
    read_back = publish.publish(artifacts, publish.shared_folder(spark, "published"))
    return publish.require_same(read_back)


@query("snk2_missing_names", """
SELECT CAST(doc_id AS VARCHAR) || '.npy' AS name FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def missing_names(spark, sf_dir):
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".npy")).alias("name")
    return publish.missing_names(
        table(spark, sf_dir, "documents").select(name), table(spark, sf_dir, "labels").select(name)
    )


@query("snk3_files_to_copy", """
SELECT d.doc_id AS name, d.n_chars AS length FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM documents t JOIN labels USING (doc_id)
                  WHERE t.doc_id = d.doc_id AND t.n_chars + labels.toxic = d.n_chars)""")
def files_to_copy(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    target = documents.join(table(spark, sf_dir, "labels"), "doc_id").select(
        F.col("doc_id").alias("name"), (F.col("n_chars") + F.col("toxic")).alias("length")
    )
    source = documents.select(F.col("doc_id").alias("name"), F.col("n_chars").alias("length"))
    return publish.files_to_copy(source, target)


@query("snk4_pending_stages", """
WITH runs AS (SELECT sha256('{"c_custkey":' || c_custkey || '}') AS config_hash, c_custkey FROM customer),
plan AS (SELECT config_hash, stage FROM runs
         CROSS JOIN (VALUES ('F'), ('O'), ('P')) s(stage)),
ledger AS (SELECT config_hash, o_orderstatus AS stage
           FROM orders JOIN runs ON c_custkey = o_custkey)
SELECT config_hash, stage FROM plan EXCEPT SELECT config_hash, stage FROM ledger""")
def pending_stages(spark, sf_dir):
    hashed = lambda df: df.withColumn("config_hash", publish.config_hash(["c_custkey"]))
    stages = F.array(F.lit("F"), F.lit("O"), F.lit("P"))
    plan = hashed(table(spark, sf_dir, "customer").select("c_custkey")).select(
        "config_hash", F.explode(stages).alias("stage")
    )
    ledger = hashed(
        table(spark, sf_dir, "orders").select(
            F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("stage"))
    )
    return publish.pending_stages(plan, ledger)


@query("snk5_config_hash", """
SELECT p_partkey, sha256('{"p_brand":"' || p_brand || '","p_size":' ||
                         CASE WHEN p_partkey % 3 = 0 THEN 'null' ELSE p_size::VARCHAR END ||
                         ',"p_type":"' || p_type || '"}') AS config_hash FROM part""")
def config_hash(spark, sf_dir):
    settings = table(spark, sf_dir, "part").withColumn(
        "p_size", F.when(F.col("p_partkey") % 3 != 0, F.col("p_size"))
    )
    return settings.select(
        "p_partkey", publish.config_hash(["p_type", "p_size", "p_brand"]).alias("config_hash")
    )


# --- splits ----------------------------------------------------------------------

PAIR_SQL = """
n AS (SELECT count(*) AS n FROM supplier),
held AS (SELECT s_suppkey AS speaker FROM supplier
         ORDER BY sha256('11|' || s_suppkey), s_suppkey LIMIT 7),
examples AS (
  SELECT kind, o_orderkey AS idx, (o_orderkey % (n * n)) // n AS spk_a, (o_orderkey % (n * n)) % n AS spk_b
  FROM orders CROSS JOIN n CROSS JOIN (VALUES ('positive'), ('adversarial')) k(kind)),
split AS (
  SELECT *, CASE WHEN spk_a IN (FROM held) OR spk_b IN (FROM held) THEN 'val' ELSE 'train' END AS split
  FROM examples),
capped AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind, split ORDER BY idx) - 1 AS place FROM split)
  WHERE place < CASE split WHEN 'train' THEN 9000 ELSE 1200 END)"""


def speakers(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("speaker"))


def held_out(spark, sf_dir):
    return splits.held_out_speakers(speakers(spark, sf_dir), HELD_OUT, SEED)


def examples(spark, sf_dir):
    a, b = splits.speaker_pair(F.col("o_orderkey"), speakers(spark, sf_dir).count())
    kinds = F.array(F.lit("positive"), F.lit("adversarial"))
    return table(spark, sf_dir, "orders").select(
        F.explode(kinds).alias("kind"), F.col("o_orderkey").alias("idx"),
        a.alias("spk_a"), b.alias("spk_b"),
    )


def split_examples(spark, sf_dir):
    return splits.assign_split(examples(spark, sf_dir), held_out(spark, sf_dir))


@query("smp1_speaker_pair", f"WITH {PAIR_SQL} SELECT * FROM examples")
def speaker_pair(spark, sf_dir):
    return examples(spark, sf_dir)


@query("smp2_held_out_speakers", f"WITH {PAIR_SQL} SELECT * FROM held")
def held_out_speakers(spark, sf_dir):
    return held_out(spark, sf_dir)


@query("smp3_smallest_total", f"""WITH {PAIR_SQL},
size AS (SELECT n, v, greatest(n - v, 1) AS u, CAST(ceil(25000 / greatest(n - v, 1)) AS BIGINT) AS q
         FROM n CROSS JOIN (SELECT count(*) AS v FROM held)),
reach AS (  -- so many rows of pairs hold both quotas: q of the n - v others, or those that give 4000 of v each
  SELECT n * greatest(q + v * CAST(ceil(q / u) AS BIGINT), CAST(ceil(4000 / greatest(v, 1)) AS BIGINT)) AS clips FROM size),
walk AS (
  SELECT i, row_number() OVER (PARTITION BY val ORDER BY i) AS rn, val FROM (
    SELECT i, ((i % (n * n)) // n IN (FROM held)) OR ((i % (n * n)) % n IN (FROM held)) AS val
    FROM n CROSS JOIN (SELECT unnest(range(0, clips)) AS i FROM reach)))
SELECT coalesce(max(i) + 1, 0) AS total FROM walk WHERE (NOT val AND rn = 25000) OR (val AND rn = 4000)""")
def smallest_total(spark, sf_dir):
    return splits.smallest_total(speakers(spark, sf_dir), held_out(spark, sf_dir), 25000, 4000)


@query("smp4_expected_holdout", """
SELECT s_nationkey, count(*) AS n, round(1 - pow((count(*) - 1) / count(*), 2), 6) AS held_out
FROM supplier GROUP BY 1""")
def expected_holdout(spark, sf_dir):
    sizes = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return sizes.withColumn(
        "held_out", F.round(splits.expected_holdout(F.col("n"), F.lit(1)), 6)
    )


@query("smp5_quota_cap", f"WITH {PAIR_SQL} SELECT kind, idx, spk_a, spk_b, split, place FROM capped")
def quota_cap(spark, sf_dir):
    return splits.cap_to_quota(split_examples(spark, sf_dir), QUOTAS)


@query("jn1_speaker_disjoint", f"""WITH {PAIR_SQL}
SELECT kind, idx, spk_a, spk_b FROM split WHERE split = 'train'""")
def speaker_disjoint(spark, sf_dir):
    rows = splits.without_speakers(examples(spark, sf_dir), held_out(spark, sf_dir))
    return rows.select("kind", "idx", "spk_a", "spk_b")


@query("agg21_split_accounting", f"""WITH {PAIR_SQL}
SELECT kind, split, count(*) AS counted, count(*) AS listed, true AS agrees,
       count(*) >= CASE split WHEN 'train' THEN 9000 ELSE 1200 END AS meets_quota
FROM capped GROUP BY kind, split""")
def split_accounting(spark, sf_dir):
    rows = pin(splits.cap_to_quota(split_examples(spark, sf_dir), QUOTAS))
    path = publish.shared_folder(spark, "split")
    rows.select("kind", "split", "idx").write.parquet(path)
    return splits.split_accounting(rows, spark.read.parquet(path), QUOTAS)


# --- text slots ---------------------------------------------------------------------

SLOT_SQL = """
texts AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS text_no, text FROM benchmark),
custom AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS text_no, text FROM conversations),
slots AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS slot FROM customer),
chosen AS (
  SELECT slot, row_number() OVER (ORDER BY slot) - 1 AS j FROM (
    SELECT slot, row_number() OVER (ORDER BY sha256('11|' || slot), slot) - 1 AS r FROM slots)
  WHERE r < round_even(0.0903 * (SELECT count(*) FROM slots), 0)),
injected AS (
  SELECT slot, text AS custom_text FROM chosen
  JOIN custom ON text_no = j % (SELECT count(*) FROM custom)),
cycled AS (
  SELECT slot, text FROM slots JOIN texts ON text_no = slot % (SELECT count(*) FROM texts))"""


def slot_tables(spark, sf_dir):
    texts = splits.numbered(
        table(spark, sf_dir, "benchmark").select("item_id", "text"), ["item_id"], "text_no"
    ).drop("item_id")
    custom = splits.numbered(
        table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"),
        ["conv_id", "turn"], "text_no",
    ).drop("conv_id", "turn")
    slots = splits.numbered(
        table(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"], "slot"
    ).select("slot")
    return texts, custom, slots


@query("smp8_text_cycle", f"WITH {SLOT_SQL} SELECT slot, text FROM cycled")
def text_cycle(spark, sf_dir):
    texts, _, slots = slot_tables(spark, sf_dir)
    return splits.cycle_texts(slots, texts)


@query("smp9_custom_injection", f"WITH {SLOT_SQL} SELECT slot, custom_text FROM injected")
def custom_injection(spark, sf_dir):
    _, custom, slots = slot_tables(spark, sf_dir)
    return splits.injection_slots(slots, 0.0903, custom, SEED)


@query("jn8_slot_overlay", f"""WITH {SLOT_SQL}
SELECT slot, coalesce(custom_text, text) AS text, custom_text IS NOT NULL AS is_custom
FROM cycled LEFT JOIN injected USING (slot)""")
def slot_overlay(spark, sf_dir):
    texts, custom, slots = slot_tables(spark, sf_dir)
    return splits.overlay(
        splits.cycle_texts(slots, texts), splits.injection_slots(slots, 0.0903, custom, SEED)
    )


@query("smp10_stress_picks", """
WITH n AS (SELECT count(*) AS n FROM supplier)
SELECT idx, (idx % (n * n)) // n AS spk_a, (idx % (n * n)) % n AS spk_b
FROM (SELECT o_orderkey AS idx FROM orders ORDER BY sha256('11|' || o_orderkey), o_orderkey LIMIT 24)
CROSS JOIN n""")
def stress_picks(spark, sf_dir):
    clips = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"))
    return splits.stress_picks(clips, 24, SEED, speakers(spark, sf_dir).count())


@query("smp11_until_seconds", """
SELECT * FROM (
  SELECT doc_id AS name, n_chars AS n_samples, CAST(coalesce(sum(n_chars) OVER (
           ORDER BY sha256('11|' || doc_id), doc_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM documents) WHERE before < 200000""")
def until_seconds(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("name"), F.col("n_chars").alias("n_samples")
    )
    return splits.until_seconds(files, 200_000, SEED)


# --- sets ------------------------------------------------------------------------------


@query("set1_labelled_union", """
SELECT doc_id, 1 AS label FROM labels WHERE quality = 1
UNION ALL SELECT doc_id, 0 FROM labels WHERE quality = 0""")
def labelled_union(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    pick = lambda q: labels.where(F.col("quality") == q).select("doc_id")
    return splits.labelled_union(pick(1), pick(0))


@query("set2_pool_union", """
SELECT 'speech' AS role, doc_id AS id FROM documents UNION ALL
SELECT 'music', page_id FROM pages UNION ALL SELECT 'env', item_id FROM benchmark""")
def pool_union(spark, sf_dir):
    parts = {"speech": ("documents", "doc_id"), "music": ("pages", "page_id"),
             "env": ("benchmark", "item_id")}
    return splits.union_all([
        table(spark, sf_dir, name).select(F.lit(role).alias("role"), F.col(key).alias("id"))
        for role, (name, key) in parts.items()
    ])


@query("set3_missing_inputs", """
SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels""")
def missing_inputs(spark, sf_dir):
    want = table(spark, sf_dir, "documents").select("doc_id")
    return want.exceptAll(table(spark, sf_dir, "labels").select("doc_id"))


@query("set4_available_conditions", """
SELECT DISTINCT text FROM documents INTERSECT SELECT text FROM conversations
UNION SELECT lang FROM (SELECT lang FROM documents INTERSECT
                        SELECT unnest(['en', 'fr', 'xx']))""")
def available_conditions(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    declared = spark.createDataFrame([("en",), ("fr",), ("xx",)], "text string")
    spoken = splits.available(
        documents.select("text"), table(spark, sf_dir, "conversations").select("text")
    )
    langs = splits.available(documents.select(F.col("lang").alias("text")), declared)
    return spoken.union(langs).distinct()


@query("set5_union_runs", """
SELECT c_custkey AS run_id, c_acctbal AS score, CAST(NULL AS VARCHAR) AS model FROM customer
UNION ALL SELECT s_suppkey, s_acctbal, s_name FROM supplier""")
def union_runs(spark, sf_dir):
    experiments = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("run_id"), F.col("c_acctbal").alias("score")
    )
    baseline = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("run_id"), F.col("s_acctbal").alias("score"),
        F.col("s_name").alias("model"),
    )
    return splits.union_all([baseline, experiments])
