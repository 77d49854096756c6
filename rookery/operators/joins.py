"""Join shapes: lookups, pre-aggregated children, semi and anti joins, many-to-many scopes, duplicates, similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..registry import query
from ..session import staged
from .windows import global_numbers


@query("j01_lookup", "v_application", "v_candidate", sql="SELECT application_id, a.candidate_id, c.name, a.status FROM v_application a LEFT JOIN v_candidate c USING (candidate_id)")
def lookup(applications: DataFrame, candidates: DataFrame) -> DataFrame:
    return applications.join(candidates.select("candidate_id", "name"), "candidate_id", "left").select("application_id", "candidate_id", "name", "status")


@query("j02_document_tags", "v_document", "v_tag", sql="""SELECT document_id, count(t.tag_id) AS tag_count, coalesce(string_agg(key || '=' || value, ',' ORDER BY key, value), '') AS tags FROM v_document LEFT JOIN v_tag t USING (document_id) GROUP BY 1""")
def document_tags(documents: DataFrame, tags: DataFrame) -> DataFrame:
    """Tag count and ordered tag list; documents without tags keep an empty list."""
    nested = tags.groupBy("document_id").agg(F.count("*").alias("tag_count"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "value"))), lambda t: F.concat_ws("=", t["key"], t["value"])), ",").alias("tags"))
    return documents.select("document_id").join(nested, "document_id", "left").fillna({"tag_count": 0, "tags": ""})


@query("j03_paragraphs_per_document", "v_document", "v_paragraph", sql="SELECT d.document_id, (SELECT count(*) FROM v_paragraph p WHERE p.document_id = d.document_id) AS paragraphs FROM v_document d")
def paragraphs_per_document(documents: DataFrame, paragraphs: DataFrame) -> DataFrame:
    counts = paragraphs.groupBy("document_id").agg(F.count("*").alias("paragraphs"))
    return documents.select("document_id").join(counts, "document_id", "left").fillna(0, ["paragraphs"])


@query("j04_two_aggregates", "v_candidate", "v_application", "lineitem", sql="""WITH a AS (SELECT candidate_id, count(*) AS applications, round(sum(amount), 2) AS amount FROM v_application GROUP BY 1),
    l AS (SELECT o.candidate_id, count(*) AS lines FROM lineitem JOIN v_application o ON l_orderkey = application_id GROUP BY 1)
    SELECT candidate_id, applications, amount, coalesce(lines, 0) AS lines FROM v_candidate LEFT JOIN a USING (candidate_id) LEFT JOIN l USING (candidate_id)""")
def two_aggregates(candidates: DataFrame, applications: DataFrame, lines: DataFrame) -> DataFrame:
    """Statistics stay null when there is nothing to count, the second count becomes 0."""
    a = applications.groupBy("candidate_id").agg(F.count("*").alias("applications"), F.round(F.sum("amount"), 2).alias("amount"))
    n = lines.groupBy(F.col("l_orderkey").alias("application_id")).agg(F.count("*").alias("n")).join(applications, "application_id")
    n = n.groupBy("candidate_id").agg(F.sum("n").alias("lines"))
    return candidates.select("candidate_id").join(a, "candidate_id", "left").join(n, "candidate_id", "left").fillna(0, ["lines"])


@query("j05_permitted_targets", "v_job", "v_grant", sql="SELECT job_id, title FROM v_job WHERE job_id IN (SELECT target FROM v_grant WHERE list_contains(permission_list, 'VIEW') AND user_id % 10 = 3)")
def permitted_targets(jobs: DataFrame, grants: DataFrame) -> DataFrame:
    seen = grants.where(F.array_contains("permission_list", "VIEW") & (F.col("user_id") % 10 == 3))
    return jobs.join(seen, jobs["job_id"] == seen["target"], "left_semi").select("job_id", "title")


@query("j06_missing_targets", "v_application", "part", "supplier", sql="""SELECT DISTINCT id, kind FROM (SELECT application_id AS id, 'part' AS kind FROM v_application UNION ALL SELECT candidate_id, 'supplier' FROM v_application) r
    WHERE NOT EXISTS (SELECT 1 FROM (SELECT CAST(p_partkey AS BIGINT) AS i, 'part' AS k FROM part UNION ALL SELECT s_suppkey, 'supplier' FROM supplier) t WHERE t.i = r.id AND t.k = r.kind)""")
def missing_targets(requests: DataFrame, parts: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Requested (id, kind) pairs that no table holds."""
    asked = requests.select(F.col("application_id").alias("id"), F.lit("part").alias("kind")).union(requests.select("candidate_id", F.lit("supplier"))).distinct()
    known = parts.select(F.col("p_partkey").cast("bigint").alias("id"), F.lit("part").alias("kind")).union(suppliers.select("s_suppkey", F.lit("supplier")))
    return asked.join(known, ["id", "kind"], "left_anti")


@query("j07_exclude_inactive", "v_embedding", "v_document", sql="SELECT e.id, e.paragraph_id FROM v_embedding e WHERE e.document_id NOT IN (SELECT document_id FROM v_document WHERE NOT is_active)")
def exclude_inactive(rows: DataFrame, documents: DataFrame) -> DataFrame:
    return rows.join(documents.where("NOT is_active"), "document_id", "left_anti").select("id", "paragraph_id")


@query("j08_lineage", "part", "supplier", "lineitem", sql="""WITH r AS (SELECT 'part' AS kind, CAST(p_partkey AS BIGINT) AS id, p_name AS name FROM part UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier),
    m AS (SELECT DISTINCT l_orderkey AS source_id, 'part' AS kind, l_partkey AS id FROM lineitem UNION ALL SELECT DISTINCT l_orderkey, 'supplier', l_suppkey FROM lineitem)
    SELECT source_id, m.kind, m.id, name FROM m LEFT JOIN r ON m.kind = r.kind AND m.id = r.id""")
def lineage(parts: DataFrame, suppliers: DataFrame, lines: DataFrame) -> DataFrame:
    """Edges to objects of several kinds, joined on kind and id."""
    objects = parts.select(F.lit("part").alias("kind"), F.col("p_partkey").cast("bigint").alias("id"), F.col("p_name").alias("name")).union(suppliers.select(F.lit("supplier"), "s_suppkey", "s_name"))
    edges = lines.select(F.col("l_orderkey").alias("source_id"), F.inline(F.array(F.struct(F.lit("part").alias("kind"), F.col("l_partkey").alias("id")), F.struct(F.lit("supplier").alias("kind"), F.col("l_suppkey").alias("id"))))).distinct()
    return edges.join(objects, ["kind", "id"], "left").select("source_id", "kind", "id", "name")


@query("j09_role_or_view", "v_grant", "supplier", sql="""SELECT DISTINCT user_id, target FROM v_grant g WHERE (list_contains(permission_list, 'ROLE') AND user_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)) OR list_contains(permission_list, 'VIEW')""")
def role_or_view(grants: DataFrame, roles: DataFrame) -> DataFrame:
    """A ROLE grant counts for users who hold the role, a VIEW grant for all; one semi join per branch."""
    holders = roles.where("s_acctbal > 5000").select(F.col("s_suppkey").alias("user_id"))
    by_role = grants.where(F.array_contains("permission_list", "ROLE")).join(holders, "user_id", "left_semi")
    return by_role.unionByName(grants.where(F.array_contains("permission_list", "VIEW"))).select("user_id", "target").distinct()


@query("j10_array_membership", "v_usage", "v_candidate", sql="""SELECT u.id, coalesce(string_agg(c.name, ',' ORDER BY c.name), '') AS names FROM (SELECT id, unnest([id % 50, id % 70, id % 90]) AS candidate_id FROM v_usage) u LEFT JOIN v_candidate c USING (candidate_id) GROUP BY 1""")
def array_membership(records: DataFrame, candidates: DataFrame) -> DataFrame:
    """Ids in an array column are exploded, joined and nested again."""
    ids = records.select("id", F.explode_outer(F.array(F.col("id") % 50, F.col("id") % 70, F.col("id") % 90)).alias("candidate_id"))
    return ids.join(candidates, "candidate_id", "left").groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))


#: Numbers of a bitmap of Spark's bitmap functions.
BUCKET = 32768
#: Most rows that may be selected on the left of new pairs.
MOST_SELECTED = 1000


@query("j11_new_pairs", "region", "nation", sql="""SELECT r_regionkey, n_nationkey FROM region, nation WHERE (r_regionkey, n_nationkey) NOT IN (SELECT n_regionkey, n_nationkey FROM nation)""")
def new_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """All pairs of two selected small sets except the existing ones."""
    chosen = [r[0] for r in left.select("r_regionkey").distinct().limit(MOST_SELECTED + 1).collect()]
    if len(chosen) > MOST_SELECTED:
        raise ValueError(f"at most {MOST_SELECTED} rows can be selected on the left")
    pairs = right.select("n_nationkey", F.explode(F.array(*[F.lit(x) for x in sorted(chosen)])).alias("r_regionkey")) if chosen else right.select("n_nationkey", F.lit(None).cast("int").alias("r_regionkey")).limit(0)
    known = right.select(F.col("n_regionkey").alias("r_regionkey"), "n_nationkey")
    return pairs.select("r_regionkey", "n_nationkey").join(known, ["r_regionkey", "n_nationkey"], "left_anti")


@query("j12_terms_in_text", "v_job", sql="""WITH t AS (SELECT DISTINCT lower(unnest(skills)) AS term FROM v_job) SELECT term, count(*) AS hits FROM t JOIN v_job j ON contains(lower(j.title), term) GROUP BY 1""")
def terms_in_text(jobs: DataFrame) -> DataFrame:
    """Substring hits of a term set. Every term here is free of blanks, so words that contain a term are found once per distinct word."""
    terms = jobs.select(F.explode("skills").alias("t")).select(F.lower("t").alias("term")).distinct()
    from ..plans.retrieval import term_hits

    return term_hits(jobs.select("job_id", F.lower("title").alias("text")), ["job_id"], "text", terms).groupBy("term").agg(F.count_distinct("job_id").alias("hits"))


@query("j13_library_scope", "v_application", "v_membership", sql="SELECT application_id FROM v_application WHERE candidate_id IN (SELECT candidate_id FROM v_membership WHERE library_id IN (3, 7, 11)) AND candidate_id IN (SELECT candidate_id FROM v_candidate WHERE status = 'ACTIVE')")
def library_scope(applications: DataFrame, membership: DataFrame, libraries: tuple[int, ...] = (3, 7, 11)) -> DataFrame:
    if len(libraries) > 50:
        raise ValueError("at most 50 libraries")
    inside = membership.where(F.col("library_id").isin(*libraries))
    return applications.join(inside, "candidate_id", "left_semi").where(F.col("candidate_id") % 13 != 0).select("application_id")


@query("j14_duplicates", "v_candidate", sql="""WITH k AS (SELECT candidate_id, library_id, 'p' || phone AS key FROM v_candidate UNION ALL SELECT candidate_id, library_id, 'e' || lower(email) FROM v_candidate)
    SELECT library_id, key, candidate_id, min(candidate_id) OVER w AS first_id, count(*) OVER w AS members FROM k WINDOW w AS (PARTITION BY library_id, key) QUALIFY members > 1""")
def duplicates(candidates: DataFrame) -> DataFrame:
    """Same phone, or same email whatever its case, within a tenant (here the library): one row per member and key, with the first member and their number.

    Members are counted per key and joined back; they are never listed in one row nor paired.
    """
    keys = candidates.select("library_id", "candidate_id", F.explode(F.array(F.concat(F.lit("p"), "phone"), F.concat(F.lit("e"), F.lower("email")))).alias("key")).where("key IS NOT NULL")
    groups = keys.groupBy("library_id", "key").agg(F.min("candidate_id").alias("first_id"), F.count("*").alias("members")).where("members > 1")
    return keys.join(groups, ["library_id", "key"]).select("library_id", "key", "candidate_id", "first_id", "members")


@query("j15_never_applied", "v_candidate", "v_application", sql="SELECT candidate_id FROM v_candidate WHERE candidate_id NOT IN (SELECT candidate_id FROM v_application WHERE job_id = 17)")
def never_applied(candidates: DataFrame, applications: DataFrame, job: int = 17) -> DataFrame:
    return candidates.join(applications.where(F.col("job_id") == job), "candidate_id", "left_anti").select("candidate_id")


_SCORE = "0.4 * {common} / {own} + CASE WHEN a.department = b.department THEN 0.3 ELSE 0.0 END + CASE WHEN a.city = b.city THEN 0.3 ELSE 0.0 END"


@query("j16_similar_jobs", "v_job", sql=f"""WITH s AS (SELECT a.job_id, b.job_id AS other_id, round({_SCORE.format(common="len(list_intersect(a.skills, b.skills))", own="len(a.skills)")}, 6) AS score FROM v_job a JOIN v_job b ON a.job_id <> b.job_id WHERE a.job_id % 20 = 0)
    SELECT job_id, other_id, score, k FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY score DESC, other_id) AS k FROM s WHERE score > 0) WHERE k <= 5""")
def similar_jobs(jobs: DataFrame, limit: int = 5) -> DataFrame:
    """0.4 skill share of the asked job + 0.3 department + 0.3 city. Asked jobs: ids divisible by 20.

    Jobs with equal skills, department and city are one class, so pairs are formed of classes. An asked class first meets those of its department and city; its
    k-th score there is a floor. Its attributes are then taken off from the most frequent on as long as their weights together stay below the floor: who
    shares only these cannot reach it, so their lists are not read. Classes that share another attribute are scored in full.
    """
    own = F.array_sort(F.array_distinct("skills"))
    rows = jobs.select("job_id", own.alias("s"), F.size("skills").alias("own"), "department", "city")
    kind = F.xxhash64("s", "department", "city")  # names a class together with what it stands for
    named = staged(rows.withColumn("cls", F.struct(kind.alias("h"), "s", "department", "city")), "similar-jobs")
    members = named.withColumn("place", numbered_in("cls", ["job_id"])).where(F.col("place") <= limit + 1)  # one of them may be the asked job
    classes = staged(members.groupBy("cls").agg(F.sort_array(F.collect_list("job_id")).alias("ids")).select(F.xxhash64("cls").alias("id"), "cls.s", "cls.department", "cls.city", "ids"), "similar-classes")
    asked = named.where("job_id % 20 = 0").select("job_id", F.xxhash64("cls").alias("id"), "s", "own", "department", "city")
    askers = staged(asked.select("id", "own", "s", "department", "city").distinct(), "similar-asked")
    other = classes.select(F.col("id").alias("other"), F.col("s").alias("os"), F.col("department").alias("od"), F.col("city").alias("oc"), "ids")

    def scored(pairs: DataFrame) -> DataFrame:
        same = lambda x, y: F.when(F.col(x) == F.col(y), 0.3).otherwise(0.0)
        score = F.round(F.coalesce(0.4 * F.size(F.array_intersect("s", "os")) / F.col("own"), F.lit(0.0)) + same("department", "od") + same("city", "oc"), 6)
        return pairs.select("id", "own", "other", score.alias("score"), "ids").where("score > 0")

    def best(hits: DataFrame, most: int) -> DataFrame:
        each = hits.select("id", "own", "score", F.explode("ids").alias("other_id"))
        return each.withColumn("r", numbered_in(["id", "own"], [F.desc("score"), "other_id"])).where(F.col("r") <= most)

    near = staged(scored(askers.join(other, (F.col("department") == F.col("od")) & (F.col("city") == F.col("oc")))), "similar-near")
    floors = best(near, limit + 1).where(F.col("r") == limit + 1).select("id", "own", F.col("score").alias("floor"))

    attributes = lambda df, *more: df.select(*more, F.explode(F.concat(F.transform("s", lambda x: F.concat(F.lit("s:"), x)), F.array(F.concat(F.lit("d:"), "department"), F.concat(F.lit("c:"), "city")))).alias("key"))
    lists = attributes(classes, "id")
    sizes = lists.groupBy("key").agg(F.count("*").alias("n"))
    wanted = attributes(askers, "id", "own").where("key IS NOT NULL").join(sizes, "key").join(floors, ["id", "own"], "left")
    weight = F.when(F.col("key").startswith("s:"), 0.4 / F.col("own")).otherwise(0.3)
    upto = F.sum(weight).over(W.partitionBy("id", "own").orderBy(F.desc("n"), "key").rowsBetween(W.unboundedPreceding, 0))
    read = wanted.withColumn("upto", upto).where(F.col("upto") + 1e-6 >= F.coalesce("floor", F.lit(0.0))).select("id", "own", "key")
    pairs = read.join(lists.select(F.col("id").alias("other"), "key"), "key").select("id", "own", "other").distinct().join(near.select("id", "own", "other"), ["id", "own", "other"], "left_anti")
    rest = scored(pairs.join(askers, ["id", "own"]).join(other, "other"))
    top = best(near.unionByName(rest), limit + 1).select("id", "own", "score", "other_id")
    found = asked.select("job_id", "id", "own").join(top, ["id", "own"]).where("job_id <> other_id")
    return found.withColumn("k", numbered_in("job_id", [F.desc("score"), "other_id"])).where(F.col("k") <= limit).select("job_id", "other_id", "score", "k")


def numbered_in(by: str | list[str], order: list) -> Column:
    return F.row_number().over(W.partitionBy(by).orderBy(*order)).cast("bigint")


@query("j17_first_disjoint", "v_job", sql="""SELECT a.job_id, min(b.job_id) AS negative_id FROM v_job a JOIN v_job b ON a.job_id <> b.job_id AND len(list_intersect(a.skills, b.skills)) = 0 WHERE len(a.skills) > 0 AND len(b.skills) > 0 GROUP BY 1""")
def first_disjoint(jobs: DataFrame) -> DataFrame:
    """The first other job with no skill in common, decided once per distinct skill set.

    Skill sets are numbered by their first job. Every skill has bitmaps over the numbers of the sets that hold it, one for each bucket of BUCKET numbers. The
    answer for a set is the first zero bit of the union of its skills' bitmaps. Counts tell beforehand which buckets matter: none behind the
    first in which the skills together hold fewer sets than there are, and none in which one skill holds them all. Pairs of sets are not formed.
    """
    sets = jobs.where(F.size("skills") > 0).withColumn("s", F.array_sort(F.array_distinct("skills")))
    groups = staged(global_numbers(sets.groupBy("s").agg(F.min("job_id").alias("first_id")), ["first_id"]).withColumn("number", F.col("number") + 1), "skill-sets")
    bucket = F.bitmap_bucket_number("number")
    member = groups.select("number", F.explode("s").alias("skill"))
    maps = staged(member.groupBy("skill", bucket.alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"), F.count("*").alias("n")), "skill-maps")
    totals = groups.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("total"))
    every = groups.select("number", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(max(1, -(-groups.count() // BUCKET))).cast("bigint"))).alias("bucket"))
    held = member.join(maps.select("skill", "bucket", "n"), "skill").groupBy("number", "bucket").agg(F.sum("n").alias("together"), F.max("n").alias("largest"))
    seen = every.join(totals, "bucket").join(held, ["number", "bucket"], "left").fillna(0, ["together", "largest"])
    sure = F.min(F.when(F.col("together") < F.col("total"), F.col("bucket"))).over(W.partitionBy("number"))
    open_ = seen.withColumn("sure", sure).where("largest < total AND bucket <= coalesce(sure, bucket)").select("number", "bucket", "total")
    union = open_.join(member, "number").join(maps.drop("n"), ["skill", "bucket"], "left").groupBy("number", "bucket", "total").agg(F.bitmap_or_agg("bits").alias("bits"))
    full = F.length(F.regexp_extract(F.hex("bits"), "^(?:FF)*", 0)) / 2  # bytes without a zero bit
    byte = F.conv(F.substring(F.hex("bits"), (2 * full + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
    bit = F.array_position(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.call_function("shiftright", byte, i).bitwiseAND(F.lit(1))), 0) - 1
    place = (8 * full + bit).cast("bigint")
    answers = union.withColumn("place", place).where(F.col("place") < F.col("total")).groupBy("number").agg(F.min((F.col("bucket") - 1) * BUCKET + F.col("place") + 1).alias("answer"))
    found = answers.join(groups.select(F.col("number").alias("answer"), F.col("first_id").alias("negative_id")), "answer").join(groups.select("number", "s"), "number")
    return sets.join(found.select("s", "negative_id"), "s").select("job_id", "negative_id")


@query("j18_dangling_rows", "v_embedding", "v_paragraph", sql="SELECT id, paragraph_id FROM v_embedding WHERE paragraph_id * 97 NOT IN (SELECT document_id FROM v_paragraph)")
def dangling_rows(rows: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Rows whose source (here 97 times the paragraph number) is gone."""
    known = paragraphs.select(F.col("document_id").alias("source")).distinct()
    return rows.join(known, F.col("paragraph_id") * 97 == F.col("source"), "left_anti").select("id", "paragraph_id")


@query("j19_candidate_detail", "v_candidate", "v_application", sql="""SELECT candidate_id, name, coalesce(string_agg(CAST(application_id AS STRING), ',' ORDER BY create_time DESC, application_id), '') AS applications FROM v_candidate LEFT JOIN v_application USING (candidate_id) GROUP BY 1, 2""")
def candidate_detail(candidates: DataFrame, applications: DataFrame) -> DataFrame:
    order = F.expr("array_sort(l, (a, b) -> CASE WHEN a.create_time > b.create_time THEN -1 WHEN a.create_time < b.create_time THEN 1 WHEN a.application_id < b.application_id THEN -1 WHEN a.application_id > b.application_id THEN 1 ELSE 0 END)")
    nested = applications.groupBy("candidate_id").agg(F.collect_list(F.struct("create_time", "application_id")).alias("l")).select("candidate_id", F.array_join(F.transform(order, lambda x: x["application_id"]), ",").alias("applications"))
    return candidates.select("candidate_id", "name").join(nested, "candidate_id", "left").fillna("", ["applications"])
