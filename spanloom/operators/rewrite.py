"""Pseudonymising texts with aliases, and restoring wordings in texts that come back.

Defined cases: null texts stay null; null keys and values of a mapping say nothing, and of several values of a key the least counts; an alias in any
writing is one key; repeated documents are rewritten each; other columns are kept; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.spans import chunks, find_spans, let, part, replace_spans, running_sums
from spanloom.operators.mapping import ALIAS_NUMBERING_SQL, alias_numbering, normalization_key
from spanloom.operators.recognizers import EMAIL, EMAIL_SQL_PATTERN, sql_spans
from spanloom.sources.tables import table

#: The category tokens that aliases are made of.
CATEGORIES = ["PERSON", "ORG", "EMAIL", "URL", "PHONE", "ADDRESS", "IDENTITY", "TAX", "BANK", "CASE", "DATE", "REDACTED"]
#: An alias: a category in any case, one separator, up to nine digits, at word edges (Cyrillic endings may follow).
TOKEN = r"(?iu)(?<![\p{L}\p{N}_])(?:" + "|".join(CATEGORIES) + r")[_\- \x{A0}][0-9]{1,9}(?![0-9A-Za-z_])"
STRICT = "^(?:" + "|".join(CATEGORIES) + ")[_-][0-9]{1,9}$"


def alias_key(token: Column) -> Column:
    """CATEGORY_number of a token as written."""
    return F.concat(F.upper(F.regexp_extract(token, "^[A-Za-z]+", 0)), F.lit("_"), F.regexp_extract(token, "[0-9]+$", 0).cast("int").cast("string"))


def with_mapping(docs: DataFrame, mapping: DataFrame, scope: str, keys: Column) -> DataFrame:
    """docs with a map from those of their keys (an array) that their scope's mapping (scope, key, value) knows.

    The keys are joined one by one and folded back, so a document carries what it mentions itself, however many identities a scope
    has. Defined cases: null keys and values say nothing; of several values of a key the least counts; a null scope knows nothing.
    """
    known = mapping.where("key is not null and value is not null").groupBy(scope, "key").agg(F.min("value").alias("value"))
    wanted = docs.withColumn("_keys", F.array_sort(F.array_distinct(F.array_compact(keys))))
    sets = wanted.where(F.size("_keys") > 0).select(scope, "_keys").distinct()
    maps = sets.select(scope, "_keys", F.explode("_keys").alias("key")).join(known, [scope, "key"]).groupBy(scope, "_keys").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("mapping"))
    return wanted.join(maps, [scope, "_keys"], "left").withColumn("mapping", F.coalesce("mapping", F.create_map().cast("map<string,string>"))).select(*docs.columns, "mapping")


def pseudonymize(docs: DataFrame, mapping: DataFrame, pattern: str, key, scope: str = "doc_id") -> DataFrame:
    """docs with pseudonymized (text with known wordings replaced by aliases) and n_replaced; unknown wordings stay. A null text
    stays null; a text without a known wording comes back as it is."""
    found = docs.withColumn("_found", F.transform(find_spans(F.col("text"), pattern), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), key(s["text"]).alias("key"))))
    found = with_mapping(found, mapping, scope, F.col("_found.key"))
    spans = let(F.col("mapping"), lambda m: F.filter(F.transform("_found", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), m[s["key"]].alias("alias"))), lambda s: s["alias"].isNotNull()))
    found = found.withColumn("_spans", spans)
    return found.withColumn("pseudonymized", replace_spans(F.col("text"), F.col("_spans"))).withColumn("n_replaced", F.size("_spans")).drop("_found", "_spans", "mapping")


def token_spans(text: Column) -> Column:
    """Aliases in a text: start, end, text, key, strict."""
    return F.transform(find_spans(text, TOKEN), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), alias_key(s["text"]).alias("key"), s["text"].rlike(STRICT).alias("strict")))


def restore(docs: DataFrame, mapping: DataFrame, scope: str = "doc_id") -> DataFrame:
    """docs with restored (aliases replaced by primary wordings), n_restored, landed (where the wordings lie in restored) and
    unresolved (strict aliases that nothing is known of; loose ones are left alone).

    A wording that ends in a period before another period gives one up. A null text restores to null, with nothing in it.
    """
    text = F.col("text")
    scanned = docs.withColumn("_tokens", token_spans(text)).withColumn("_after", F.transform("_tokens", lambda s: F.lit(False)))
    followed = let(chunks(text), lambda c: F.transform("_tokens", lambda s: part(c, s["end"], s["end"] + 1) == "."))
    scanned = scanned.withColumn("_after", F.when(F.size("_tokens") > 0, followed).otherwise(F.col("_after")))
    found = with_mapping(scanned, mapping, scope, F.col("_tokens.key"))

    def one(m: Column, s: Column, period: Column) -> Column:
        wording = m[s["key"]]
        value = F.when(wording.endswith(".") & period, F.substring(wording, F.lit(1), F.length(wording) - 1)).otherwise(wording)
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), value.alias("alias"))

    spans = let(F.col("mapping"), lambda m: F.filter(F.zip_with("_tokens", "_after", lambda s, p: one(m, s, p)), lambda s: s["alias"].isNotNull()))
    found = found.withColumn("_spans", spans)
    size = lambda s: F.length(s["alias"])
    moved = let(running_sums(F.transform("_spans", lambda s: size(s) - (s["end"] - s["start"]))), lambda by: F.transform("_spans", lambda s, k: F.struct((s["start"] + F.get(by, k)).cast("int").alias("start"), (s["start"] + F.get(by, k) + size(s)).cast("int").alias("end"))))
    landed = F.when(F.size("_spans") > 0, moved).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
    lost = let(F.col("mapping"), lambda m: F.transform(F.filter("_tokens", lambda s: s["strict"] & m[s["key"]].isNull()), lambda s: s["text"]))
    return (
        found.withColumn("restored", replace_spans(text, F.col("_spans"))).withColumn("n_restored", F.size("_spans")).withColumn("landed", landed).withColumn("unresolved", F.array_distinct(lost)).drop("_spans", "_tokens", "_after", "mapping")
    )


def realias(docs: DataFrame, renames: DataFrame, scope: str = "doc_id") -> DataFrame:
    """docs with aliases renamed (scope, key, value) all at once, so that swaps work."""
    found = with_mapping(docs.withColumn("_tokens", token_spans(F.col("text"))), renames, scope, F.col("_tokens.key"))
    pick = lambda m: F.filter(F.transform("_tokens", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), m[s["key"]].alias("alias"))), lambda s: s["alias"].isNotNull())
    return found.withColumn("_spans", let(F.col("mapping"), pick)).withColumn("realiased", replace_spans(F.col("text"), F.col("_spans"))).drop("_spans", "_tokens", "mapping")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = alias_numbering(spark, sf_dir).select("doc_id", "key", F.col("alias").alias("value"))
    return pseudonymize(_documents(spark, sf_dir), mapping, EMAIL, normalization_key)


def pseudonymize_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forward(spark, sf_dir).select("doc_id", F.md5("pseudonymized").alias("text_md5"), F.length("pseudonymized").alias("n_chars"), "n_replaced")


PSEUDONYMIZE_SQL = f"""
WITH p AS (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '({EMAIL_SQL_PATTERN})', chr(57344) || '\\1' || chr(57344), 'g'), chr(57344)) AS p FROM documents)),
r AS (SELECT p.doc_id, string_agg(CASE WHEN i % 2 = 0 THEN alias ELSE piece END, '' ORDER BY i) AS t, count(*) FILTER (WHERE i % 2 = 0) AS n FROM p LEFT JOIN ({ALIAS_NUMBERING_SQL}) a ON a.doc_id = p.doc_id AND p.i % 2 = 0 AND a.key = lower(piece) GROUP BY p.doc_id)
SELECT doc_id, md5(t) AS text_md5, length(t)::INTEGER AS n_chars, n::INTEGER AS n_replaced FROM r
"""


def _mapping_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alias_numbering(spark, sf_dir).select("doc_id", F.col("alias").alias("key"), F.col("key").alias("value"))


def restore_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts pseudonymised and restored: whether each comes back (wordings in lower case), and what was restored."""
    sent = _forward(spark, sf_dir).select("doc_id", F.col("text").alias("original"), F.col("pseudonymized").alias("text"))
    back = restore(sent, _mapping_back(spark, sf_dir))
    return back.select("doc_id", "n_restored", F.size("landed").alias("n_landed"), F.size("unresolved").alias("n_unresolved"), (F.lower("restored") == F.lower("original")).alias("same"))


RESTORE_SQL = f"SELECT doc_id, coalesce(n, 0)::INTEGER AS n_restored, coalesce(n, 0)::INTEGER AS n_landed, 0::INTEGER AS n_unresolved, true AS same FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n FROM {sql_spans(EMAIL_SQL_PATTERN)} GROUP BY doc_id) USING (doc_id)"


def token_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases in replies that mention strict, loose, known and unknown ones (made from orders)."""
    n = F.col("o_orderkey")
    reply = F.concat(F.lit("Ask PERSON_"), n % 7 + 1, F.lit(" and person "), n % 3 + 1, F.lit(", not Org-"), n % 5, F.lit("x, about EMAIL_"), n % 11, F.lit("."))
    replies = table(spark, sf_dir, "orders").select("o_orderkey", reply.alias("text"))
    return replies.select("o_orderkey", F.inline(token_spans(F.col("text")))).select("o_orderkey", F.col("start").alias("start_cp"), F.col("end").alias("end_cp"), F.col("text").alias("token"), "key", "strict")


TOKEN_SCAN_SQL = """
WITH r AS (SELECT o_orderkey, 'PERSON_' || (o_orderkey % 7 + 1) AS a, 'person ' || (o_orderkey % 3 + 1) AS b, 'EMAIL_' || (o_orderkey % 11) AS c, length('Ask PERSON_1 and person 1, not Org-1x, about ') AS pos FROM orders)
SELECT o_orderkey, 4 AS start_cp, (4 + length(a))::INTEGER AS end_cp, a AS token, a AS key, true AS strict FROM r
UNION ALL SELECT o_orderkey, 17, (17 + length(b))::INTEGER, b, upper(replace(b, ' ', '_')), false FROM r
UNION ALL SELECT o_orderkey, pos::INTEGER, (pos + length(c))::INTEGER, c, c, true FROM r
"""


def unresolved_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict aliases that no mapping knows: only PERSON_1 to PERSON_4 and EMAIL_1 to EMAIL_9 are known."""
    scanned = token_scan(spark, sf_dir)
    known = spark.range(1, 5).select(F.concat(F.lit("PERSON_"), "id").alias("key")).unionByName(spark.range(1, 10).select(F.concat(F.lit("EMAIL_"), "id").alias("key")))
    return scanned.where("strict").join(known, "key", "left_anti").groupBy("key").agg(F.count("*").alias("n"))


UNRESOLVED_SQL = f"SELECT key, count(*) AS n FROM ({TOKEN_SCAN_SQL}) WHERE strict AND key NOT IN (SELECT 'PERSON_' || i FROM range(1, 5) r(i)) AND key NOT IN (SELECT 'EMAIL_' || i FROM range(1, 10) r(i)) GROUP BY key"


def conversations_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies restored with a mapping per conversation: PERSON_k stands for the k-th role that spoke."""
    turns = table(spark, sf_dir, "conversations")
    roles = turns.groupBy("conv_id", "role").agg(F.min("turn").alias("first"))
    from pyspark.sql import Window

    mapping = roles.select("conv_id", F.concat(F.lit("PERSON_"), F.row_number().over(Window.partitionBy("conv_id").orderBy("first", "role"))).alias("key"), F.concat("role", F.lit(".")).alias("value"))
    replies = turns.select("conv_id", "turn", F.concat(F.lit("As PERSON_1 said to person 2 and PERSON_9. So PERSON_2."), F.lit("")).alias("text"))
    back = restore(replies, mapping, "conv_id")
    return back.select("conv_id", "turn", "restored", "n_restored", F.array_join("unresolved", ",").alias("unresolved"), F.array_join(F.transform("landed", lambda x: F.concat_ws(":", x["start"], x["end"])), ",").alias("landed"))


CONVERSATIONS_SQL = """
WITH r AS (SELECT conv_id, role, min(turn) AS f FROM conversations GROUP BY 1, 2), k AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY f, role) AS k FROM r),
m AS (SELECT conv_id, max(CASE WHEN k = 1 THEN role END) AS a, max(CASE WHEN k = 2 THEN role END) AS b FROM k GROUP BY conv_id)
SELECT c.conv_id, c.turn, 'As ' || a || '. said to ' || coalesce(b || '.', 'person 2') || ' and PERSON_9. So ' || coalesce(b, 'PERSON_2') || '.' AS restored,
  (1 + CASE WHEN b IS NULL THEN 0 ELSE 2 END)::INTEGER AS n_restored, CASE WHEN b IS NULL THEN 'PERSON_9,PERSON_2' ELSE 'PERSON_9' END AS unresolved,
  '3:' || (4 + length(a)) || CASE WHEN b IS NULL THEN '' ELSE ',' || (4 + length(a) + 9) || ':' || (14 + length(a) + length(b)) || ',' || (14 + length(a) + length(b) + 18) || ':' || (14 + length(a) + 2 * length(b) + 18) END AS landed
FROM conversations c JOIN m USING (conv_id)
"""


def realias_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Swapped aliases: PERSON_1 and PERSON_2 change places in one pass."""
    docs = table(spark, sf_dir, "nation").select("n_nationkey", F.concat("n_name", F.lit(": PERSON_1, PERSON_2; person-1, PERSON_12.")).alias("text"))
    swap = table(spark, sf_dir, "nation").select("n_nationkey", F.inline(F.array(*[F.struct(F.lit(a).alias("key"), F.lit(b).alias("value")) for a, b in (("PERSON_1", "PERSON_2"), ("PERSON_2", "PERSON_1"))])))
    return realias(docs, swap, "n_nationkey").select("n_nationkey", "realiased")


REALIAS_SQL = "SELECT n_nationkey, n_name || ': PERSON_2, PERSON_1; PERSON_2, PERSON_12.' AS realiased FROM nation"


def hand_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The note that goes with a text: its first two distinct aliases, in order."""
    docs = _forward(spark, sf_dir).select("doc_id", F.slice(F.array_distinct(F.transform(token_spans(F.col("pseudonymized")), lambda s: s["text"])), 1, 2).alias("a"))
    return docs.where(F.size("a") > 0).select("doc_id", F.concat(F.lit("Keep tokens such as "), F.array_join("a", " and "), F.lit(" as they are.")).alias("note"))


HAND_OFF_SQL = f"SELECT doc_id, 'Keep tokens such as ' || string_agg(alias, ' and ' ORDER BY number) || ' as they are.' AS note FROM ({ALIAS_NUMBERING_SQL}) WHERE number <= 2 GROUP BY doc_id"

QUERIES = [
    ("pseudonymize_emails", pseudonymize_emails, PSEUDONYMIZE_SQL), ("restore_round_trip", restore_round_trip, RESTORE_SQL), ("token_scan", token_scan, TOKEN_SCAN_SQL), ("unresolved_tokens", unresolved_tokens, UNRESOLVED_SQL),
    ("conversations_restore", conversations_restore, CONVERSATIONS_SQL), ("realias_swap", realias_swap, REALIAS_SQL), ("hand_off", hand_off, HAND_OFF_SQL),
]
