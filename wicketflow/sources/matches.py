"""Match documents: nested JSON, one document a match, read with one explicit schema and flattened to deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from wicketflow.sources import archives

#: The kinds of extras in the order in which a ball's extra type is decided.
EXTRAS = (("wides", "wide"), ("noballs", "noball"), ("byes", "bye"), ("legbyes", "legbye"), ("penalty", "penalty"))

#: The fields of a document.
_DDL = (
    "match_id string, info struct<match_type:string,team_type:string,gender:string,balls_per_over:int,dates:array<string>,season:string,venue:string,city:string,teams:array<string>,"
    "players:map<string,array<string>>,registry:struct<people:map<string,string>>,toss:struct<winner:string,decision:string>,"
    "outcome:struct<winner:string,result:string,method:string,eliminator:string,by:struct<runs:int,wickets:int,innings:int>>,player_of_match:array<string>,event:struct<name:string,match_number:int>>,"
    "innings array<struct<team:string,declared:boolean,all_out:boolean,follow_on:boolean,overs:array<struct<over:int,deliveries:array<struct<batter:string,bowler:string,non_striker:string,"
    "runs:struct<batter:int,extras:int,total:int,non_boundary:boolean>,extras:map<string,int>,wickets:array<struct<player_out:string,kind:string,fielders:array<struct<name:string>>>>>>>>>>"
)


def read_matches(spark: SparkSession, *paths: str) -> DataFrame:
    """Documents under paths with their file; a malformed file is one row with _corrupt set. The id defaults to the file's stem."""
    raw = spark.read.schema(f"{_DDL}, _corrupt string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(list(paths))
    file = F.col("_metadata.file_path")
    return raw.withColumn("file", file).withColumn("match_id", F.coalesce("match_id", F.regexp_extract(file, r"([^/]+?)(?:\.[A-Za-z]+)*$", 1)))


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Documents under paths, one a line, with their file."""
    return spark.read.schema(_DDL).json(list(paths)).withColumn("file", F.col("_metadata.file_path"))


def read_zip(spark: SparkSession, path: str, **options) -> DataFrame:
    """The same from ZIP archives of documents at or under path; an archive's documents are dealt to several tasks."""
    rows = archives.read_members(spark, path, ending=".json", **options).withColumn("d", F.from_json(F.col("content").cast("string"), _DDL))
    return rows.select("d.*", F.concat_ws("!", "archive", "member").alias("file")).withColumn("match_id", F.coalesce("match_id", F.regexp_extract("file", r"([^/!]+?)(?:\.[A-Za-z]+)*$", 1)))


def several_sources(matches: DataFrame) -> DataFrame:
    """(match_id, n, files): matches whose document lies in several files, of one root or of many. matches: read_matches()."""
    return matches.groupBy("match_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("file")).alias("files")).where("n > 1")


def write_prepared(lines: DataFrame, path: str, *, gender: str = "male", remap: bool = True, compression: str = "gzip") -> dict[str, int]:
    """Writes the documents of lines (file, value: JSON text) that prepared() takes, and counts what became of all, in one pass.

    Counts: total, malformed (no JSON object with info), filtered_out (of another gender), format_remapped (of those written),
    written. The id of a document without one is its file's stem. remap: whether twenty-over matches between countries become
    T20I. compression: of the files written (none: as text). Counts come from an observation of the pass that writes; nothing is read twice.
    """
    parsed = lines.select("file", F.from_json("value", f"{_DDL}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("d"))
    malformed = F.coalesce(F.col("d._corrupt").isNotNull(), F.lit(True)) | F.col("d.info").isNull()
    other = ~malformed & (F.lit(False) if gender == "all" else ~F.coalesce(F.col("d.info.gender") == gender, F.lit(False)))
    came = F.col("d.info.match_type")
    moved = ~malformed & ~other & (came == "T20") & (F.col("d.info.team_type") == "international") & F.lit(remap)
    told = parsed.select("file", "d", malformed.alias("malformed"), other.alias("other"), F.coalesce(moved, F.lit(False)).alias("moved"))
    counts = Observation()
    fields = {"total": F.lit(True), "malformed": F.col("malformed"), "filtered_out": F.col("other"), "format_remapped": F.col("moved"), "written": ~F.col("malformed") & ~F.col("other")}
    seen = told.observe(counts, *[F.count(F.when(c, 1)).alias(k) for k, c in fields.items()])
    docs = seen.where("NOT malformed AND NOT other").select("file", "moved", "d.*").drop("_corrupt")
    format_ = F.when(F.col("moved"), "T20I").otherwise(F.col("info.match_type"))
    docs = docs.withColumn("meta", F.struct(F.col("info.match_type").alias("original_match_type"), format_.alias("prepared_format"))).withColumn("info", F.col("info").withField("match_type", format_))
    docs.withColumn("match_id", F.coalesce("match_id", F.regexp_extract("file", r"([^/!]+?)(?:\.[A-Za-z]+)*$", 1))).drop("file", "moved").write.json(path, compression=compression)
    return {k: counts.get[k] for k in fields}


def result_type(outcome: str = "info.outcome") -> F.Column:
    text = F.lower(F.regexp_replace(F.coalesce(F.col(f"{outcome}.result"), F.lit("")), " ", "_"))
    return F.when(F.col(f"{outcome}.winner").isNotNull(), "win").when(text.isin("tie", "draw", "no_result", "abandoned"), text).otherwise("no_result")


def flatten(matches: DataFrame) -> DataFrame:
    """One row a ball: three explodes, extras as columns, all wickets kept and the first one flat."""
    info = matches.select(
        "match_id", F.get("info.dates", 0).try_cast("date").alias("match_date"), F.col("info.match_type").alias("format"), F.col("info.season").alias("season"), F.col("info.venue").alias("venue"), F.col("info.city").alias("city"),
        F.get("info.teams", 0).alias("team_a"), F.get("info.teams", 1).alias("team_b"), F.col("info.toss.winner").alias("toss_winner"), F.col("info.toss.decision").alias("toss_decision"), F.col("info.outcome.winner").alias("winner"),
        result_type().alias("result_type"), F.col("info.outcome.by.runs").alias("win_by_runs"), F.col("info.outcome.by.wickets").alias("win_by_wickets"), F.coalesce("info.balls_per_over", F.lit(6)).alias("balls_per_over"),
        F.col("info.event.name").alias("event_name"), F.col("info.event.match_number").alias("match_number"), F.col("info.registry.people").alias("people"), F.posexplode("innings").alias("i", "inn"),
    )
    overs = info.select("*", F.explode("inn.overs").alias("o")).select("*", F.posexplode("o.deliveries").alias("b", "d"))
    get = lambda k: F.coalesce(F.col("d.extras")[k], F.lit(0))
    kind = F.lit(None).cast("string")
    for key, name in reversed(EXTRAS):
        kind = F.when(get(key) > 0, name).otherwise(kind)
    first = F.get("d.wickets", 0)
    kept = [c for c in info.columns if c not in ("i", "inn", "people")]
    return overs.select(
        *kept, (F.col("i") + 1).alias("innings_number"), F.col("o.over").alias("over_number"), (F.col("b") + 1).alias("ball_in_over"), F.col("inn.team").alias("batting_team"),
        F.when(F.col("inn.team") == F.col("team_a"), F.col("team_b")).otherwise(F.col("team_a")).alias("bowling_team"), F.col("d.batter").alias("batter"), F.col("d.bowler").alias("bowler"), F.col("d.non_striker").alias("non_striker"),
        F.col("d.runs.batter").alias("runs_batter"), F.col("d.runs.extras").alias("runs_extras"), F.col("d.runs.total").alias("runs_total"), F.coalesce("d.runs.non_boundary", F.lit(False)).alias("non_boundary"), kind.alias("extra_type"),
        *[get(k).alias(f"extras_{k}") for k, _ in EXTRAS], (F.size(F.coalesce("d.wickets", F.array())) > 0).alias("is_wicket"), first["kind"].alias("wicket_type"), first["player_out"].alias("dismissed_player"),
        F.get(first["fielders"], 0)["name"].alias("fielder"), F.col("d.wickets").alias("wickets"), F.coalesce("inn.declared", F.lit(False)).alias("innings_declared"), F.col("people")[F.col("d.batter")].alias("batter_id_ext"), F.col("people")[F.col("d.bowler")].alias("bowler_id_ext"),
    )


def prepared(matches: DataFrame, *, gender: str = "male") -> DataFrame:
    """Documents of one gender (``all``: of any) with meta: the format as it came, and as it counts here.

    Twenty-over matches between countries are T20I.
    """
    rows = matches if gender == "all" else matches.where(F.col("info.gender") == gender)
    came = F.col("info.match_type")
    counts = F.when((came == "T20") & (F.col("info.team_type") == "international"), "T20I").otherwise(came)
    return rows.withColumn("meta", F.struct(came.alias("original_match_type"), counts.alias("prepared_format"))).withColumn("info", F.col("info").withField("match_type", counts))


def problems(matches: DataFrame) -> DataFrame:
    """(problem, n): documents without an id, without innings, with innings that lack team or overs, and sound ones; one pass."""
    inn = F.coalesce("innings", F.array())
    checks = {
        "missing_match_id": F.col("match_id").isNull(), "missing_innings": F.size(inn) == 0, "innings_without_team": F.exists(inn, lambda x: x["team"].isNull()),
        "innings_without_overs": F.exists(inn, lambda x: x["overs"].isNull()), "valid": F.col("match_id").isNotNull() & (F.size(inn) > 0) & ~F.exists(inn, lambda x: x["team"].isNull() | x["overs"].isNull()),
    }
    one = matches.agg(*[F.count(F.when(c, 1)).alias(k) for k, c in checks.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("problem"), F.col(k).alias("n")) for k in checks])))


def profile(matches: DataFrame) -> DataFrame:
    """Numbers and dates of documents by format, gender and type of team."""
    day = F.get("info.dates", 0).try_cast("date")
    return matches.groupBy(F.col("info.match_type").alias("format"), "info.gender", "info.team_type").agg(F.count("*").alias("matches"), F.min(day).alias("first_date"), F.max(day).alias("last_date"))


def first_files(matches: DataFrame, n: int) -> DataFrame:
    """The documents of the first n files by path; n names come to the driver, and only those files are read then."""
    names = [x["file"] for x in matches.select("file").distinct().orderBy("file").limit(n).collect()]
    return matches.where(F.col("file").isin(names))


def registries(matches: DataFrame) -> DataFrame:
    """(name, team, ids): the register's ids of each name in a team's elevens."""
    squads = matches.select(F.col("info.registry.people").alias("people"), F.explode("info.players").alias("team", "names")).select("people", "team", F.explode("names").alias("name"))
    return squads.select("name", "team", F.col("people")[F.col("name")].alias("id")).groupBy("name", "team").agg(F.sort_array(F.collect_set("id")).alias("ids"))


def write_zips(documents: DataFrame, path: str, each: int) -> DataFrame:
    """Documents (value: JSON text) as ZIP archives of about so many under path; (archive, members) of each."""
    parts = max(1, -(-documents.count() // each))
    rows = documents.select("value", F.concat(F.sha1("value"), F.lit(".json")).alias("name")).repartition(parts)
    return archives.write_archives(rows, "name", "value", path)


def delivery_count(matches: DataFrame) -> DataFrame:
    """Balls per document from the sizes of the nested arrays, without an explode."""
    zero = F.lit(0)
    per_innings = lambda a, i: a + F.aggregate(F.coalesce(i["overs"], F.array()), zero, lambda x, o: x + F.coalesce(F.size(o["deliveries"]), zero))
    return matches.select("match_id", F.aggregate("innings", zero, per_innings).cast("long").alias("deliveries"))


def as_documents(d: DataFrame) -> DataFrame:
    """Deliveries back as match documents; an innings' balls meet in one row, which is a match's size.

    Matches are dealt out once: overs, innings and documents are then grouped where they are.
    """
    d = d.repartition("match_id")
    extras = F.map_filter(F.create_map(*[x for k in ("wides", "noballs", "byes", "legbyes", "penalty") for x in (F.lit(k), F.col(f"extras_{k}"))]), lambda k, v: v > 0)
    wicket = F.when(F.col("is_wicket"), F.array(F.struct(F.col("dismissed_player").alias("player_out"), F.col("wicket_type").alias("kind"), F.array(F.struct(F.col("fielder").alias("name"))).alias("fielders"))))
    runs = F.struct(F.col("runs_batter").alias("batter"), F.col("runs_extras").alias("extras"), F.col("runs_total").alias("total"), "non_boundary")
    ball = F.struct("ball_in_over", F.struct("batter", "bowler", "non_striker", runs.alias("runs"), extras.alias("extras"), wicket.alias("wickets")).alias("d"))
    head = ["match_id", "match_date", "format", "venue", "season", "team_a", "team_b"]
    overs = d.groupBy(*head, "innings_number", "batting_team", "over_number").agg(F.collect_list(ball).alias("balls"))
    over = F.struct(F.col("over_number").alias("over"), F.transform(F.array_sort("balls", lambda a, b: a["ball_in_over"] - b["ball_in_over"]), lambda x: x["d"]).alias("deliveries"))
    innings = overs.groupBy(*head, "innings_number", "batting_team").agg(F.collect_list(over).alias("overs"))
    inn = F.struct("innings_number", F.struct(F.col("batting_team").alias("team"), F.array_sort("overs", lambda a, b: a["over"] - b["over"]).alias("overs")).alias("i"))
    docs = innings.groupBy(*head).agg(F.collect_list(inn).alias("innings"))
    info = F.struct(F.col("format").alias("match_type"), F.array(F.col("match_date").cast("string")).alias("dates"), "season", "venue", F.array("team_a", "team_b").alias("teams"))
    return docs.select("match_id", info.alias("info"), F.transform(F.array_sort("innings", lambda a, b: a["innings_number"] - b["innings_number"]), lambda x: x["i"]).alias("innings"))
