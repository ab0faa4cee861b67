"""Nested records, one JSON object a line, with a strict schema and a reject reason for every bad line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

# The ordered enums of a record.
SIZES = ("1-10", "11-50", "51-200", "201-500", "501-1000", "1001-5000", "5001-10000", "10001+")
TIERS = ("tier_1", "tier_2", "tier_3", "tier_4", "unknown")
PROFICIENCIES = ("beginner", "intermediate", "advanced", "expert")
LANGUAGE_LEVELS = ("basic", "conversational", "professional", "native")
WORK_MODES = ("remote", "hybrid", "onsite", "flexible")

ID_PATTERN = r"^CAND_[0-9]{7}$"
SIGNALS = "signals"


def record_schema(signals: str = SIGNALS) -> T.StructType:
    """The whole record; ``signals`` names the field that holds the activity signals."""
    return T._parse_datatype_string(
        f"""candidate_id string,
        profile struct<anonymized_name:string,headline:string,summary:string,location:string,country:string,years_of_experience:double,current_title:string,current_company:string,current_company_size:string,current_industry:string>,
        career_history array<struct<company:string,title:string,start_date:date,end_date:date,duration_months:int,is_current:boolean,industry:string,company_size:string,description:string>>,
        education array<struct<institution:string,degree:string,field_of_study:string,start_year:int,end_year:int,grade:string,tier:string>>,
        skills array<struct<name:string,proficiency:string,endorsements:int,duration_months:int>>,
        certifications array<struct<name:string,issuer:string,year:int>>,
        languages array<struct<language:string,proficiency:string>>,
        {signals} struct<profile_completeness_score:double,signup_date:date,last_active_date:date,open_to_work_flag:boolean,profile_views_received_30d:int,applications_submitted_30d:int,recruiter_response_rate:double,avg_response_time_hours:double,
        skill_assessment_scores:map<string,double>,connection_count:int,endorsements_received:int,notice_period_days:int,expected_salary_range_inr_lpa:struct<min:double,max:double>,preferred_work_mode:string,willing_to_relocate:boolean,
        github_activity_score:double,search_appearance_30d:int,saved_by_recruiters_30d:int,interview_completion_rate:double,offer_acceptance_rate:double,verified_email:boolean,verified_phone:boolean,linkedin_connected:boolean>"""
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """SRC-1, SRC-3: (file, line_no, source_index, line); gzip by suffix.

    Lines are numbered within their file without a sort: each block counts its
    lines, and the counts of the blocks before, one short row a block, say where
    it starts.  Blank lines take a line number and no index.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"), F.monotonically_increasing_id().alias("at"))
    blank = F.length(F.trim(F.coalesce("line", F.lit("")))) == 0
    # Counted anew without blank lines, which gives the index.
    kept = raw.where(~blank).withColumn("kept_at", F.monotonically_increasing_id())
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)

    def starts(rows: DataFrame, at: str, first: str, start: str) -> DataFrame:
        counts = rows.groupBy("file", "block").agg(F.min(at).alias(first), F.count("*").alias("n"))
        return F.broadcast(counts.select("file", "block", first, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(start)))

    placed = kept.join(starts(raw, "at", "first", "lines"), ["file", "block"]).join(starts(kept, "kept_at", "kept_first", "kept_lines"), ["file", "block"])
    return placed.select("file", (F.col("lines") + F.col("at") - F.col("first") + 1).alias("line_no"), (F.col("kept_lines") + F.col("kept_at") - F.col("kept_first")).alias("source_index"), "line")


def _outside(x: Column, lo: float, hi: float | None = None) -> Column:
    return (x < lo) | (x > hi if hi is not None else F.lit(False)) | F.isnan(x.cast("double"))


def _keys(node: str, names: set[str]) -> Column:
    """Whether an object of the line has a key that the schema doesn't know."""
    known = F.array(*map(F.lit, sorted(names)))
    return F.size(F.array_except(F.coalesce(F.json_object_keys(F.get_json_object("line", node)), F.array().cast("array<string>")), known)) > 0


def parse_records(lines: DataFrame, signals: str = SIGNALS) -> DataFrame:
    """SRC-2, SRC-5: the lines' columns with ``record`` (strings trimmed) and ``reject_reason``, of which one is null."""
    schema = record_schema(signals)
    with_bad = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    v = F.try_parse_json("line")
    parsed = lines.select("*", v.alias("v"), F.from_json("line", with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "dateFormat": "yyyy-MM-dd"}).alias("r"))
    r, p, s = F.col("r"), F.col("r")["profile"], F.col("r")[signals]
    required = F.lit(False)
    for node, struct in ((r, schema), (p, schema["profile"].dataType), (s, schema[signals].dataType)):
        for f in struct.fields:
            required = required | node[f.name].isNull()
    nested = {f"$.{n}": {f.name for f in schema[n].dataType.fields} for n in ("profile", signals)}
    unknown = _keys("$", {f.name for f in schema.fields})
    for node, names in nested.items():
        unknown = unknown | _keys(node, names)
    salary = s["expected_salary_range_inr_lpa"]
    roles, edu, skills = r["career_history"], r["education"], r["skills"]
    missing_inner = (
        F.exists(roles, lambda x: x["company"].isNull() | x["title"].isNull() | x["start_date"].isNull() | x["duration_months"].isNull() | x["is_current"].isNull() | x["company_size"].isNull() | x["industry"].isNull() | x["description"].isNull())
        | F.exists(edu, lambda x: x["start_year"].isNull() | x["end_year"].isNull() | x["tier"].isNull() | x["field_of_study"].isNull() | x["degree"].isNull() | x["institution"].isNull())
        | F.exists(skills, lambda x: x["name"].isNull() | x["proficiency"].isNull() | x["endorsements"].isNull())
    )
    bounds = (
        _outside(p["years_of_experience"], 0, 50) | _outside(s["profile_completeness_score"], 0, 100) | _outside(s["recruiter_response_rate"], 0, 1) | _outside(s["avg_response_time_hours"], 0)
        | _outside(s["notice_period_days"], 0, 180) | _outside(salary["min"], 0) | _outside(salary["max"], 0) | _outside(s["github_activity_score"], -1, 100) | _outside(s["interview_completion_rate"], 0, 1)
        | _outside(s["offer_acceptance_rate"], -1, 1) | F.exists(F.map_values(s["skill_assessment_scores"]), lambda x: _outside(x, 0, 100))
        | F.exists(roles, lambda x: x["duration_months"] < 0) | F.exists(skills, lambda x: (x["endorsements"] < 0) | F.coalesce(x["duration_months"] < 0, F.lit(False)))
    )
    for c in ("profile_views_received_30d", "applications_submitted_30d", "connection_count", "endorsements_received", "search_appearance_30d", "saved_by_recruiters_30d"):
        bounds = bounds | (s[c] < 0)
    enums = (
        ~p["current_company_size"].isin(*SIZES) | ~s["preferred_work_mode"].isin(*WORK_MODES)
        | F.exists(roles, lambda x: ~x["company_size"].isin(*SIZES)) | F.exists(edu, lambda x: ~x["tier"].isin(*TIERS)) | F.exists(skills, lambda x: ~x["proficiency"].isin(*PROFICIENCIES))
        | F.exists(r["languages"], lambda x: ~x["proficiency"].isin(*LANGUAGE_LEVELS))
    )
    yes = lambda c: F.coalesce(c, F.lit(False))
    reason = (
        F.when(F.contains("line", F.lit("�")), "BAD_UTF8")
        .when(F.col("v").isNull(), "MALFORMED_JSON")
        .when(~F.schema_of_variant("v").startswith("OBJECT"), "NOT_AN_OBJECT")
        .when(yes(unknown), "UNKNOWN_KEY")
        .when(r["_bad"].isNotNull(), "WRONG_TYPE")
        .when(yes(required) | yes(missing_inner) | (F.length(F.trim(p["anonymized_name"])) == 0), "MISSING_FIELD")
        .when(~yes(F.trim(r["candidate_id"]).rlike(ID_PATTERN)), "BAD_ID")
        .when(~yes(F.size(roles).between(1, 10)) | yes(F.size(edu) > 5), "BAD_CARDINALITY")
        .when(yes(enums), "BAD_ENUM")
        .when(yes(bounds), "OUT_OF_RANGE")
    )
    trim = lambda x, names: F.struct(*((F.trim(x[f.name]) if isinstance(f.dataType, T.StringType) else x[f.name]).alias(f.name) for f in names))
    fields = []
    for f in schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            fields.append(_trim_array(r[f.name], f.dataType.elementType.fields).alias(f.name))
        elif isinstance(f.dataType, T.StructType):
            fields.append(trim(r[f.name], f.dataType.fields).alias(f.name))
        else:
            fields.append(F.trim(r[f.name]).alias(f.name))
    told = parsed.withColumn("reject_reason", reason)
    return told.withColumn("record", F.when(F.col("reject_reason").isNull(), F.struct(*fields))).drop("v", "r")


def _trim_array(xs: Column, fields: list[T.StructField]) -> Column:
    return F.transform(xs, lambda x: F.struct(*((F.trim(x[f.name]) if isinstance(f.dataType, T.StringType) else x[f.name]).alias(f.name) for f in fields)))


def ingest(records: DataFrame, policy: str = "skip") -> DataFrame:
    """SRC-6: parsed records with repeated ids rejected (the first wins), or an error on the first reject.

    Only ids and places go through the shuffle that finds repeats.
    """
    # The id straight from the line: taken out of the record it would carry all reject conditions into the join's key.
    own = F.trim(F.get_json_object("line", "$.candidate_id"))
    good = records.where("reject_reason is null").select(own.alias("__id"), "file", "line_no")
    first = good.groupBy("__id").agg(F.min(F.struct("file", "line_no")).alias("first"))
    keyed = records.withColumn("__id", own).join(first, "__id", "left")
    repeat = F.col("reject_reason").isNull() & ((F.col("first.file") != F.col("file")) | (F.col("first.line_no") != F.col("line_no")))
    reason = F.when(repeat, "DUPLICATE_ID").otherwise(F.col("reject_reason"))
    out = keyed.withColumn("reject_reason", reason).withColumn("record", F.when(F.col("reject_reason").isNull(), F.col("record"))).drop("__id", "first")
    if policy == "abort":
        stop = F.when(F.col("reject_reason").isNotNull(), F.raise_error(F.concat(F.lit("line "), F.col("line_no"), F.lit(": "), F.col("reject_reason"))).cast("boolean")).otherwise(F.lit(True))
        out = out.where(stop)
    return out


def read_records(spark: SparkSession, path: str, policy: str = "skip", signals: str = SIGNALS) -> DataFrame:
    """Lines to records: file, line_no, source_index, line, record, reject_reason."""
    return ingest(parse_records(read_lines(spark, path), signals), policy)


def sample_head(records: DataFrame, n: int = 100) -> DataFrame:
    """SRC-13: the first n decodable records."""
    return records.where("reject_reason is null").orderBy("file", "line_no").limit(n)


def only_ids(records: DataFrame, ids: DataFrame, id_col: str = "candidate_id") -> DataFrame:
    """SRC-14: records of the given ids."""
    return records.where("reject_reason is null").join(ids.select(F.col(id_col).alias("__id")), F.col("record.candidate_id") == F.col("__id"), "left_semi")
