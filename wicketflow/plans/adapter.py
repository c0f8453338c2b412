"""Ball-by-ball tables derived from the driver's star schema.

No cricket data exists in the test tables, so lineitem is projected to deliveries by one SQL text that is valid in Spark and
in DuckDB; matches and players follow from it. Real data come in through wicketflow.sources.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from wicketflow.operators import innings
from wicketflow.sources.shared import staged

#: The common table expressions b, o, e, deliveries, matches and players; {lineitem} is the source.
BALLS = """
b AS (SELECT *, CAST(FLOOR(l_orderkey/60.0) AS INT) AS m, CASE WHEN l_orderkey % 60 < 30 THEN 1 ELSE 2 END AS inn, CAST(l_quantity AS INT) AS q FROM {lineitem}),
o AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY m, inn ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS INT) AS ord,
  CASE m % 4 WHEN 0 THEN 'T20' WHEN 1 THEN 'T20I' WHEN 2 THEN 'ODI' ELSE 'Test' END AS format,
  CAST(FLOOR(m/4.0) AS INT) % 6 AS ta, (CAST(FLOOR(m/4.0) AS INT) % 6 + 1 + CAST(FLOOR(m/24.0) AS INT) % 5) % 6 AS tb FROM b),
e AS (SELECT *, CASE WHEN l_partkey % 25 = 0 THEN 'wide' WHEN l_partkey % 50 = 7 THEN 'noball' WHEN l_partkey % 50 = 13 THEN 'bye' WHEN l_partkey % 50 = 21 THEN 'legbye' END AS extra_type,
  (l_partkey % 23 = 5 AND l_partkey % 25 <> 0) AS is_wicket,
  CAST(FLOOR(ord / CASE WHEN format='ODI' THEN 2.0 ELSE 6.0 END) AS INT) AS over_number, ord % CASE WHEN format='ODI' THEN 2 ELSE 6 END + 1 AS ball_in_over,
  CASE WHEN inn=1 THEN ta ELSE tb END AS bt, CASE WHEN inn=1 THEN tb ELSE ta END AS wt FROM o),
g AS (SELECT m, CONCAT('m', CAST(m AS STRING)) AS match_id, DATE '2022-01-01' + m * 5 AS match_date, format, CONCAT('V', CAST(m % 7 AS STRING)) AS venue, inn AS innings_number, over_number, ball_in_over,
  CONCAT('Team', CAST(ta AS STRING)) AS team_a, CONCAT('Team', CAST(tb AS STRING)) AS team_b,
  CONCAT('Team', CAST(bt AS STRING)) AS batting_team, CONCAT('Team', CAST(wt AS STRING)) AS bowling_team,
  CONCAT('T', CAST(bt AS STRING), 'P', CAST(CAST(FLOOR(ord/12.0) AS INT) % 11 AS STRING)) AS batter,
  CONCAT('T', CAST(bt AS STRING), 'P', CAST((CAST(FLOOR(ord/12.0) AS INT) + 1) % 11 AS STRING)) AS non_striker,
  CONCAT('T', CAST(wt AS STRING), 'P', CAST(5 + over_number % 6 AS STRING)) AS bowler,
  CASE WHEN is_wicket OR extra_type IN ('wide','bye','legbye') THEN 0 ELSE q % 7 END AS runs_batter, CASE WHEN extra_type IS NULL THEN 0 ELSE 1 + q % 2 END AS runs_extras,
  extra_type, (l_linenumber = 7) AS non_boundary, is_wicket, l_orderkey % 10 AS lk,
  CASE WHEN is_wicket THEN CASE l_orderkey % 5 WHEN 0 THEN 'caught' WHEN 1 THEN 'bowled' WHEN 2 THEN 'run out' WHEN 3 THEN 'lbw' ELSE 'stumped' END END AS wicket_type FROM e),
deliveries AS (SELECT m, match_id, match_date, format, venue, innings_number, over_number, ball_in_over, team_a, team_b, batting_team, bowling_team, batter, non_striker, bowler, runs_batter, runs_extras,
  runs_batter + runs_extras AS runs_total, extra_type, CASE WHEN extra_type = 'wide' THEN runs_extras ELSE 0 END AS extras_wides, CASE WHEN extra_type = 'noball' THEN runs_extras ELSE 0 END AS extras_noballs,
  CASE WHEN extra_type = 'bye' THEN runs_extras ELSE 0 END AS extras_byes, CASE WHEN extra_type = 'legbye' THEN runs_extras ELSE 0 END AS extras_legbyes, 0 AS extras_penalty,
  non_boundary, is_wicket, wicket_type, CASE WHEN is_wicket THEN CASE WHEN wicket_type = 'run out' AND lk = 7 THEN non_striker ELSE batter END END AS dismissed_player,
  CASE WHEN wicket_type IN ('caught', 'run out', 'stumped') THEN REPLACE(bowler, 'P', 'P1') END AS fielder,
  CONCAT('Cup ', CAST(m % 3 AS STRING)) AS competition, CAST(YEAR(match_date) AS STRING) AS season FROM g)"""
TOTALS = """
tot AS (SELECT match_id, CAST(SUM(CASE WHEN innings_number = 1 THEN runs_total ELSE 0 END) AS BIGINT) AS first_runs, CAST(SUM(CASE WHEN innings_number = 2 THEN runs_total ELSE 0 END) AS BIGINT) AS second_runs,
  CAST(SUM(CASE WHEN innings_number = 2 AND is_wicket THEN 1 ELSE 0 END) AS BIGINT) AS second_wickets, COUNT(DISTINCT innings_number) AS innings, MIN(m) AS m, MIN(match_date) AS match_date, MIN(format) AS format, MIN(venue) AS venue,
  MIN(team_a) AS team_a, MIN(team_b) AS team_b, MIN(competition) AS competition, MIN(season) AS season FROM deliveries GROUP BY match_id),
matches AS (SELECT match_id, match_date, format, venue, team_a, team_b, competition, season, first_runs, second_runs, second_wickets, CAST(m % 97 AS INT) AS match_number,
  CASE WHEN m % 2 = 0 THEN team_a ELSE team_b END AS toss_winner, CASE WHEN m % 3 = 0 THEN 'bat' ELSE 'field' END AS toss_decision,
  CASE WHEN m % 20 = 3 OR first_runs = second_runs THEN NULL WHEN first_runs > second_runs THEN team_a ELSE team_b END AS winner,
  CASE WHEN m % 20 = 3 THEN 'draw' WHEN first_runs = second_runs THEN 'tie' ELSE 'win' END AS result_type FROM tot)"""
PLAYERS = """
players AS (SELECT CONCAT('T', CAST(n_nationkey % 6 AS STRING), 'P', CAST(p AS STRING)) AS player,
  CASE p % 3 WHEN 0 THEN 'right-arm fast' WHEN 1 THEN 'left-arm orthodox' ELSE 'right-arm offbreak' END AS bowling_style
  FROM (SELECT DISTINCT n_nationkey % 6 AS n_nationkey FROM {nation}) n CROSS JOIN (SELECT DISTINCT n_nationkey % 11 AS p FROM {nation}) p)
"""
CTES = ",".join((BALLS, TOTALS, PLAYERS))


def _whole(sql: str) -> str:
    """sql for Spark, its floors of quotients as whole division: the same numbers, but Spark divides by 60.0 in decimals, an object a value."""
    sql = sql.replace("FLOOR(ord / CASE WHEN format='ODI' THEN 2.0 ELSE 6.0 END)", "(ord DIV CASE WHEN format='ODI' THEN 2 ELSE 6 END)")
    return re.sub(r"FLOOR\((\w+)/(\d+)\.0\)", r"((\1 - pmod(\1, \2)) DIV \2)", sql)


def _counts_as_bigint(sql: str) -> str:
    """count_if(...) cast to BIGINT: DuckDB's own result is a 128-bit number."""
    out, at = [], 0
    while (i := sql.find("count_if(", at)) >= 0:
        depth, j = 1, i + 9
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            j += 1
        out += [sql[at:i], f"CAST({sql[i:j]} AS BIGINT)"]
        at = j
    return "".join([*out, sql[at:]])


def oracle(body: str) -> str:
    """DuckDB SQL: body over deliveries, flags (see FLAGS), matches and players."""
    return "WITH " + CTES.format(lineitem="lineitem", nation="nation").strip() + ",\n" + FLAGS + _counts_as_bigint(body.strip())


#: The scoring rules in SQL, for the oracles only.
FLAGS = """flags AS (SELECT *, coalesce(extra_type, '') <> 'wide' AS faced, coalesce(extra_type, '') NOT IN ('wide', 'noball') AS legal, runs_batter + extras_wides + extras_noballs AS charged,
  (is_wicket AND wicket_type NOT IN ('run out', 'retired hurt', 'retired out', 'retired not out', 'obstructing the field', 'handled the ball', 'hit the ball twice', 'timed out')) AS credited,
  (is_wicket AND wicket_type NOT IN ('retired hurt', 'retired not out')) AS dismissed, (runs_batter = 4 AND NOT non_boundary) AS four, (runs_batter = 6 AND NOT non_boundary) AS six,
  CASE WHEN format = 'Test' THEN 'general' WHEN format = 'ODI' THEN CASE WHEN over_number <= 9 THEN 'powerplay' WHEN over_number <= 39 THEN 'middle' ELSE 'death' END
    WHEN over_number <= 5 THEN 'powerplay' WHEN over_number <= 14 THEN 'middle' ELSE 'death' END AS phase FROM deliveries)
"""


class Tables:
    """The derived tables of one folder, built when they are first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _sql(self, select: str) -> DataFrame:
        return self.spark.sql(f"WITH {_whole(CTES)} {select}", lineitem=self.raw("lineitem"), nation=self.raw("nation"))

    def stored(self) -> Tables:
        """The same tables with deliveries and matches written once: for queries that read them several times."""
        return Stored(self.spark, self.sf_dir)

    @cached_property
    def deliveries(self) -> DataFrame:
        return self._sql("SELECT * FROM deliveries")

    @cached_property
    def matches(self) -> DataFrame:
        return self._sql("SELECT * FROM matches")

    @cached_property
    def bat_lines(self) -> DataFrame:
        """batting_lines(), written once: for queries that read them several times."""
        return staged(innings.batting_lines(self.deliveries), "batting")

    @cached_property
    def bowl_lines(self) -> DataFrame:
        return staged(innings.bowling_lines(self.deliveries), "bowling")

    @cached_property
    def players(self) -> DataFrame:
        return self._sql("SELECT * FROM players")


class Stored(Tables):
    """Tables that are numbered and named once; matches are summed from the written deliveries."""

    def stored(self) -> Tables:
        return self

    @cached_property
    def deliveries(self) -> DataFrame:
        return staged(self._sql("SELECT * FROM deliveries"), "deliveries")

    @cached_property
    def matches(self) -> DataFrame:
        sums = self.spark.sql(f"WITH deliveries AS (SELECT * FROM {{balls}}),{TOTALS} SELECT * FROM matches", balls=self.deliveries)
        return staged(sums, "matches")
