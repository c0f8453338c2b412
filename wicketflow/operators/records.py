"""Careers as scorecards record them: full careers from deliveries, and official ones with named elevens from match documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wicketflow.functions import rules as r
from wicketflow.operators import innings

PHASES = ("powerplay", "middle", "death")


def _phase_sums(phase: Column, runs: Column, counted: Column, wicket: Column | None = None) -> list[Column]:
    out = []
    for p in PHASES:
        out += [r.total(F.when(phase == p, runs).otherwise(0)).alias(f"{p}_runs"), r.count_if((phase == p) & counted).alias(f"{p}_balls")]
        out += [] if wicket is None else [r.total(F.when(phase == p, wicket).otherwise(0)).alias(f"{p}_wickets")]
    return out


def career_batting_full(d: DataFrame) -> DataFrame:
    """Career, phases and situations of each batter and format: one aggregate by innings, one by player.

    An innings is one with a ball as striker; dismissals are capped by innings. average without a dismissal is the runs;
    consistency is 100 (1 - deviation / mean) of runs an innings, not below 0, from five innings on.
    """
    who = ["format", "match_id", "innings_number"]
    faced, phase = r.ball_faced(), r.phase()
    striker = d.where("batter is not null and batter <> ''").select(
        *who, F.col("batter").alias("player"), F.col("runs_batter").alias("runs"), faced.alias("faced"), (faced & (F.col("runs_total") == 0)).alias("dot"), r.boundary(4).alias("four"), r.boundary(6).alias("six"), phase.alias("phase"), F.lit(1).alias("strikes"), F.lit(False).alias("gone")
    )
    no = F.lit(False)
    gone = d.where(r.batter_out() & F.col("dismissed_player").isNotNull()).select(*who, F.col("dismissed_player").alias("player"), F.lit(0).alias("runs"), no.alias("faced"), no.alias("dot"), no.alias("four"), no.alias("six"), F.lit("").alias("phase"), F.lit(0).alias("strikes"), F.lit(True).alias("gone"))
    lines = striker.unionByName(gone).groupBy(*who, "player").agg(
        r.total("runs").alias("runs"), r.count_if(F.col("faced")).alias("balls"), r.count_if(F.col("dot")).alias("dots"), r.count_if(F.col("four")).alias("fours"), r.count_if(F.col("six")).alias("sixes"), F.max("strikes").alias("bats"), F.max("gone").alias("gone"),
        *_phase_sums(F.col("phase"), F.col("runs"), F.col("faced")),
    )
    bats, x = F.col("bats") == 1, F.when(F.col("bats") == 1, F.col("runs"))
    out = lines.groupBy("player", "format").agg(
        F.countDistinct(F.when(bats, F.col("match_id"))).alias("matches"), r.count_if(bats).alias("innings"), *[r.total(c).alias(c) for c in ("runs", "balls", "dots", "fours", "sixes")], r.count_if(F.col("gone")).alias("dismissals"), F.max(x).alias("highest"),
        r.count_if(bats & F.col("runs").between(50, 99)).alias("fifties"), r.count_if(bats & (F.col("runs") >= 100)).alias("hundreds"), *[r.total(f"{p}_{c}").alias(f"{p}_{c}") for p in PHASES for c in ("runs", "balls")],
        *[r.total(F.when(F.col("innings_number") == n, F.col(c)).otherwise(0)).alias(f"{s}_{c}") for s, n in (("first", 1), ("chasing", 2)) for c in ("runs", "balls")], F.avg(x).alias("mean"), F.stddev_samp(x).alias("deviation"),
    ).where("innings > 0")
    lost = F.least("dismissals", "innings")
    out = out.withColumn("dismissals", lost).withColumn("not_outs", F.col("innings") - lost)
    out = out.withColumn("average", F.coalesce(r.ratio(F.col("runs"), F.col("dismissals")), F.col("runs").cast("double"))).withColumn("strike_rate", r.ratio(F.col("runs"), F.col("balls"), 100))
    out = out.withColumn("boundary_pct", r.ratio(F.col("fours") + F.col("sixes"), F.col("balls"), 100)).withColumn("dot_pct", r.ratio(F.col("dots"), F.col("balls"), 100))
    for p in (*PHASES, "first", "chasing"):
        out = out.withColumn(f"{p}_strike_rate", r.ratio(F.col(f"{p}_runs"), F.col(f"{p}_balls"), 100))
    even = F.greatest(F.lit(0.0), (1 - F.col("deviation") / F.greatest("mean", F.lit(0.01))) * 100)
    return out.withColumn("consistency", F.when(F.col("innings") >= 5, even)).drop("mean", "deviation")


def career_bowling_full(d: DataFrame) -> DataFrame:
    """Career and phases of each bowler and format, with the share of balls that went for a boundary."""
    legal = r.legal_ball()
    hit = r.boundary(4) | r.boundary(6)
    out = d.where("bowler is not null and bowler <> ''").groupBy(F.col("bowler").alias("player"), "format").agg(
        F.countDistinct("match_id").alias("matches"), F.countDistinct("match_id", "innings_number").alias("innings"), r.count_if(legal).alias("balls"), r.total(r.bowler_runs()).alias("conceded"), r.count_if(r.bowler_wicket()).alias("wickets"),
        r.count_if(legal & (F.col("runs_total") == 0)).alias("dots"), r.count_if(hit).alias("boundaries"), *_phase_sums(r.phase(), r.bowler_runs(), legal, r.bowler_wicket().cast("int")),
    )
    out = out.withColumn("economy", r.ratio(F.col("conceded"), F.col("balls"), 6)).withColumn("average", r.ratio(F.col("conceded"), F.col("wickets"))).withColumn("strike_rate", r.ratio(F.col("balls"), F.col("wickets")))
    out = out.withColumn("dot_pct", r.ratio(F.col("dots"), F.col("balls"), 100)).withColumn("boundary_pct", r.ratio(F.col("boundaries"), F.col("balls"), 100))
    for p in PHASES:
        out = out.withColumn(f"{p}_economy", r.ratio(F.col(f"{p}_runs"), F.col(f"{p}_balls"), 6))
    return out


def appearances(matches: DataFrame) -> DataFrame:
    """(player, format, match_id) for everyone in a match's named elevens, once a match."""
    squads = matches.select("match_id", F.col("info.match_type").alias("format"), F.explode(F.flatten(F.map_values("info.players"))).alias("player"))
    return squads.where("player is not null and trim(player) <> ''").distinct()


def _kind(w: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(F.coalesce(w["kind"], F.lit("")), "_", " ")))


def _phase_of(form: str, over: str) -> str:
    """The phase of an over as SQL, for nested balls."""
    cases = [f"WHEN {form} IN ({', '.join(repr(f) for f in r.MULTI_DAY)}) THEN 'general'"]
    for name, (first, second) in r.PHASES.items():
        cases.append(f"WHEN {form} = '{name}' THEN CASE WHEN {over} <= {first} THEN 'powerplay' WHEN {over} <= {second} THEN 'middle' ELSE 'death' END")
    first, second = r.PHASES["T20"]
    return f"CASE {' '.join(cases)} WHEN {over} <= {first} THEN 'powerplay' WHEN {over} <= {second} THEN 'middle' ELSE 'death' END"


_FACT = "player string, innings int, named int, seen int, bats int, runs int, faced int, dot int, four int, six int, gone int, bowls int, legal int, charged int, taken int, maiden int, still int, hit int, phase string"


def _fact(**given: str) -> str:
    """One element of facts(): what isn't given is 0."""
    names = [f.split()[0] for f in _FACT.split(", ")]
    return "named_struct(" + ", ".join(f"'{n}', {given.get(n, repr('') if n == 'phase' else '0')}" for n in names) + ")"


def facts(matches: DataFrame) -> DataFrame:
    """What each document says of its players, in one read of it: match_id, format, and a row for each

    name in an eleven (named), batter of a ball (seen; bats: on strike), player out (gone, all of a ball's) and bowler of an
    over (bowls, with the over's sums: legal balls, runs charged, wickets taken, maiden, dots as still, boundaries as hit).
    Overs are summed by functions on the nested arrays, before anything is exploded.
    """
    kind = "trim(lower(regexp_replace(coalesce(w.kind, ''), '_', ' ')))"
    no_bowlers, no_out = (", ".join(repr(k) for k in x) for x in (r.NOT_BOWLERS, r.NOT_OUT))
    extra = lambda k: f"coalesce(d.extras['{k}'], 0)"
    wide, noball, real = f"{extra('wides')} > 0", f"({extra('noballs')} > 0 AND {extra('wides')} = 0)", "NOT coalesce(d.runs.non_boundary, false)"
    num = lambda c: f"CAST(coalesce({c}, false) AS INT)"
    four, six = f"(d.runs.batter = 4 AND {real})", f"(d.runs.batter = 6 AND {real})"
    charged = f"coalesce(d.runs.batter, 0) + {extra('wides')} + {extra('noballs')}"
    taken = f"size(filter(coalesce(d.wickets, array()), w -> {kind} NOT IN ({no_bowlers})))"
    phase, n = _phase_of("format", "o.over"), "i + 1"
    bat = _fact(player="d.batter", innings=n, seen="1", bats="1", runs="coalesce(d.runs.batter, 0)", faced=num(f"NOT ({wide})"), dot=num(f"NOT ({wide}) AND d.runs.total = 0"), four=num(four), six=num(six), phase=phase)
    other = _fact(player="p", innings=n, seen="1")
    gone = f"transform(filter(coalesce(d.wickets, array()), w -> {kind} NOT IN ({no_out}) AND coalesce(w.player_out, d.batter) IN (d.batter, d.non_striker)), w -> {_fact(player='coalesce(w.player_out, d.batter)', innings=n, gone='1')})"
    balls = "coalesce(o.deliveries, array())"
    batters = f"concat(transform({balls}, d -> {bat}), transform(array_distinct(transform({balls}, d -> d.non_striker)), p -> {other}), flatten(transform({balls}, d -> {gone})))"
    sums = {"legal": num(f"NOT ({wide}) AND NOT {noball}"), "charged": charged, "taken": taken, "still": num(f"NOT ({wide}) AND NOT {noball} AND d.runs.total = 0"), "hit": num(f"{four} OR {six}")}
    summed = {k: f"aggregate(filter({balls}, d -> d.bowler = p), 0, (s, d) -> s + {v})" for k, v in sums.items()}
    summed["maiden"] = num(f"{summed['legal']} >= 6 AND {summed['charged']} = 0")
    bowlers = f"transform(array_distinct(transform({balls}, d -> d.bowler)), p -> {_fact(player='p', innings=n, bowls='1', phase=phase, **summed)})"
    played = f"flatten(transform(coalesce(innings, array()), (inn, i) -> flatten(transform(coalesce(inn.overs, array()), o -> concat({batters}, {bowlers})))))"
    squads = f"transform(array_distinct(flatten(coalesce(map_values(info.players), array()))), p -> {_fact(player='p', innings='0', named='1')})"
    rows = matches.withColumn("format", F.col("info.match_type")).select("match_id", "format", F.expr(f"inline(concat({squads}, {played}))"))
    return rows.where("player is not null and trim(player) <> ''")


def official_lines(matches: DataFrame, players: DataFrame | None = None) -> DataFrame:
    """The lines of every match, innings and player, of facts(): what both careers are made of, to be staged for the two.

    A document is one row, so its facts are summed where they are read, before they are shuffled. players: (k, id), names
    without case and whom they mean (identity.resolver); without it a player is a name as written. Names that it doesn't know
    have a null player and their own name.
    """
    counts = [f.split()[0] for f in _FACT.split(", ")][3:-1]
    phases = [r.total(F.when(F.col("phase") == p, F.col(c)).otherwise(0)).alias(f"{p}_{c}") for p in PHASES for c in ("runs", "faced", "legal", "charged", "taken")]
    lines = facts(matches).groupBy("match_id", "format", "innings", F.col("player").alias("name")).agg(F.max("named").alias("named"), *[r.total(c).alias(c) for c in counts], *phases)
    if players is None:
        return lines.withColumn("player", F.col("name"))
    return lines.join(players.select(F.col("k").alias("_k"), F.col("id").alias("player")), F.lower(F.regexp_replace(F.trim("name"), r"\s+", " ")) == F.col("_k"), "left").drop("_k")


def unresolved_names(lines: DataFrame) -> DataFrame:
    """(name, lines): names of official_lines() that no player is known for."""
    return lines.where("player is null").groupBy("name").agg(F.count("*").alias("lines"))


def batting_careers(lines: DataFrame) -> DataFrame:
    """Careers from batting cards; matches are appearances in a named eleven, with a turn at bat or without.

    lines: official_lines(). Players without an innings have nulls for their best and rates.
    """
    rows, bats = lines.where("player is not null"), (F.col("innings") > 0) & (F.col("seen") > 0)
    own = lambda c: F.when(bats, F.col(c)).otherwise(0)
    sums = {"runs": "runs", "balls": "faced", "fours": "four", "sixes": "six"}
    out = rows.groupBy("player", "format").agg(
        F.max(F.when(bats, F.col("runs"))).alias("highest"), F.countDistinct(F.when(F.col("named") == 1, F.col("match_id"))).alias("matches"), r.count_if(bats).alias("innings"), r.count_if(bats & (F.col("gone") == 0)).alias("not_outs"), *[r.total(own(c)).alias(k) for k, c in sums.items()],
        r.count_if(bats & F.col("runs").between(50, 99)).alias("fifties"), r.count_if(bats & (F.col("runs") >= 100)).alias("hundreds"), *[r.total(F.when(F.col("innings") == n, own(c)).otherwise(0)).alias(f"{s}_{k}") for s, n in (("first", 1), ("chasing", 2)) for k, c in (("runs", "runs"), ("balls", "faced"))],
        r.total("dot").alias("dots"), *[r.total(f"{p}_{c}").alias(f"{p}_{k}") for p in PHASES for k, c in (("runs", "runs"), ("balls", "faced"))], r.count_if(bats | (F.col("named") == 1)).alias("_any"),
    ).where("_any > 0").drop("_any")
    return out.withColumn("average", r.ratio(F.col("runs"), F.greatest(F.col("innings") - F.col("not_outs"), F.lit(0)))).withColumn("strike_rate", r.ratio(F.col("runs"), F.col("balls"), 100))


def bowling_careers(lines: DataFrame) -> DataFrame:
    """Careers from bowling cards: maidens, best figures (most wickets, then fewest runs), fours and fives, dots, boundaries, phases.

    lines: official_lines(). All wickets of a ball count that are the bowler's.
    """
    best = F.min(F.struct((-F.col("taken")).alias("w"), F.col("charged").alias("r")))
    sums = {"balls": "legal", "conceded": "charged", "wickets": "taken", "maidens": "maiden", "dots": "still", "boundaries": "hit"}
    out = lines.where("bowls > 0 and player is not null").groupBy("player", "format").agg(
        F.countDistinct("match_id").alias("matches"), F.count("*").alias("innings"), *[r.total(c).alias(k) for k, c in sums.items()], r.count_if(F.col("taken") == 4).alias("fours_w"), r.count_if(F.col("taken") >= 5).alias("fives_w"), best.alias("best"),
        *[r.total(f"{p}_{c}").alias(f"{p}_{k}") for p in PHASES for k, c in (("balls", "legal"), ("runs", "charged"), ("wickets", "taken"))],
    )
    out = out.withColumn("best_figures", F.concat((-F.col("best.w")).cast("string"), F.lit("/"), F.col("best.r").cast("string"))).drop("best")
    out = out.withColumn("economy", r.ratio(F.col("conceded"), F.col("balls"), 6)).withColumn("average", r.ratio(F.col("conceded"), F.col("wickets"))).withColumn("strike_rate", r.ratio(F.col("balls"), F.col("wickets")))
    return out.withColumn("dot_pct", r.ratio(F.col("dots"), F.col("balls"), 100)).withColumn("boundary_pct", r.ratio(F.col("boundaries"), F.col("balls"), 100))


def official_batting(matches: DataFrame, players: DataFrame | None = None) -> DataFrame:
    """batting_careers() of match documents."""
    return batting_careers(official_lines(matches, players))


def official_bowling(matches: DataFrame, players: DataFrame | None = None) -> DataFrame:
    """bowling_careers() of match documents."""
    return bowling_careers(official_lines(matches, players))


def official_matchups(d: DataFrame, least: int = 10) -> DataFrame:
    """Batter against bowler with every wicket of a ball that is the batter's and the bowler's; pairs with at least so many balls.

    d: flatten(), whose wickets column holds all of a ball.
    """
    fell = F.size(F.filter(F.coalesce("wickets", F.array()), lambda w: (w["player_out"] == F.col("batter")) & ~_kind(w).isin(*r.NOT_BOWLERS)))
    faced, hit = r.ball_faced(), r.boundary(4) | r.boundary(6)
    return d.where("batter is not null and bowler is not null").groupBy("batter", "bowler", "format").agg(
        r.count_if(faced).alias("balls"), r.total("runs_batter").alias("runs"), r.total(fell).alias("wickets"), r.count_if(faced & (F.col("runs_total") == 0)).alias("dots"), r.count_if(hit).alias("boundaries"), r.count_if(r.boundary(6)).alias("sixes")
    ).where(F.col("balls") >= least).withColumn("strike_rate", r.ratio(F.col("runs"), F.col("balls"), 100)).withColumn("average", r.ratio(F.col("runs"), F.col("wickets")))


def card_problems(batting: DataFrame, bowling: DataFrame) -> DataFrame:
    """(match_id, innings_number, problem, n): negative figures, strike rates above 400, bowling that adds up to less than batting."""
    key = ["match_id", "innings_number"]
    fast = (F.col("balls") > 0) & (F.col("runs") * 100 > F.col("balls") * 400)
    bat = batting.groupBy(*key).agg(r.count_if((F.col("runs") < 0) | (F.col("balls") < 0)).alias("negative batting"), r.count_if(fast).alias("strike rate above 400"), r.total("runs").alias("made"))
    bowl = bowling.groupBy(*key).agg(r.count_if((F.col("conceded") < 0) | (F.col("balls") < 0) | (F.col("wickets") < 0)).alias("negative bowling"), r.total("conceded").alias("conceded"))
    both = bat.join(bowl, key, "full").withColumn("bowling below batting", F.coalesce(F.col("conceded") < F.col("made"), F.lit(False)).cast("long"))
    names = ["negative batting", "strike rate above 400", "negative bowling", "bowling below batting"]
    return both.select(*key, F.inline(F.array(*[F.struct(F.lit(n).alias("problem"), F.coalesce(n, F.lit(0)).alias("n")) for n in names]))).where("n > 0")
