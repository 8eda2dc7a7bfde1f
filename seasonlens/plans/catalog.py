"""Registered queries: ``name -> fn(spark, sf_dir) -> DataFrame``.

Each query runs a library operator over the whole binding of the test tables
and flattens nested results into plain columns (doubles rounded to 6 places,
times as epoch numbers) so the DuckDB statements in ``oracle.py`` can be
compared with them row for row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonlens.operators import document as doc
from seasonlens.operators import streaks as st
from seasonlens.operators import summaries as su
from seasonlens.session import apply_sql_conf
from seasonlens.sources import binding

R = 6
NUDGE = 1e-9  # same tie-breaking nudge as the oracle (see oracle.NUDGE)
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def wrap(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            apply_sql_conf(spark)
            return fn(spark, sf_dir)

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return run

    return wrap


def rnd(c: str | Column, alias: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    out = F.round(col + F.lit(NUDGE), R)
    return out.alias(alias or (c if isinstance(c, str) else "value"))


def secs(c: str | Column) -> Column:
    return F.unix_seconds(F.col(c) if isinstance(c, str) else c)


def _dims(spark: SparkSession, sf_dir: str):
    return binding.dimensions(spark, sf_dir)


def _setup(spark: SparkSession, sf_dir: str):
    dims = _dims(spark, sf_dir)
    return dims, binding.features(spark, sf_dir, dims)


# ------------------------------------------------------------- C and D
@register("c01_c10_features")
def features_query(spark, sf_dir):
    """Per-game derived features and the mode label."""
    _, feat = _setup(spark, sf_dir)
    return feat.select(
        "puuid", "year", "matchId", secs("gameDate").alias("gameTs"), "month", "hour", "dayOfWeek",
        rnd("csPerMin"), rnd("kda"), rnd("dmgPerMin"), rnd("dmgTakenPerMin"), rnd("hoursPlayed"), "gameMode",
    )


@register("d01_item_names")
def item_names_query(spark, sf_dir):
    """Latest -> old -> id text, over every part id."""
    dims = _dims(spark, sf_dir)
    ids = binding.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("itemId"))
    return dims.item(ids, "itemId", "itemName").select("itemId", "itemName")


@register("d02_d04_names")
def names_query(spark, sf_dir):
    """Spell, rune and mode names of every game."""
    dims, feat = _setup(spark, sf_dir)
    out = dims.spell(feat, "summoner1Id", "spell1Name")
    out = dims.spell(out, "summoner2Id", "spell2Name")
    out = dims.rune(out, "perks.primaryStyle", "primaryStyle")
    out = dims.rune(out, "perks.subStyle", "subStyle")
    return out.select("matchId", "spell1Name", "spell2Name", "primaryStyle", "subStyle", "gameMode")


# ---------------------------------------------------------------- E
@register("e01_e04_champion_stats")
def champion_query(spark, sf_dir):
    """Champion x mode stats with the best game."""
    dims, feat = _setup(spark, sf_dir)
    c = su.champion_stats(feat, dims)
    b = "bestGame."
    return c.select(
        "puuid", "year", "championName", "gameMode", "gamesPlayed", rnd("winRate"), rnd("avgKDA"),
        rnd("avgCSperMin"),
        F.col(b + "kills").alias("bestKills"), F.col(b + "deaths").alias("bestDeaths"),
        F.col(b + "assists").alias("bestAssists"), rnd(b + "kda", "bestKda"), F.col(b + "win").alias("bestWin"),
        secs(b + "gameDate").alias("bestGameTs"), F.col(b + "gameMode").alias("bestGameMode"),
        F.col(b + "primaryRune").alias("bestPrimaryRune"), F.col(b + "secondaryRune").alias("bestSecondaryRune"),
        F.col(b + "summonerSpells")[0].alias("bestSpell1"), F.col(b + "summonerSpells")[1].alias("bestSpell2"),
    )


def _explode_modes(nested: DataFrame, by: list[str]) -> DataFrame:
    return nested.select(*by, F.explode("modes").alias("e")).select(*by, "e.*")


@register("e05_e07_item_stats")
def item_query(spark, sf_dir):
    """Item x mode stats, read back out of the nested item summary."""
    from seasonlens.session import stage

    dims, feat = _setup(spark, sf_dir)
    feat = stage(feat.select("puuid", "year", *su.ITEM_COLUMNS), "item_features")  # read twice
    flat = _explode_modes(su.item_summary(su.item_stats(feat, dims)), ["puuid", "year", "itemName"])
    return flat.select(
        "puuid", "year", "itemName", "gameMode", "usageCount", rnd("winRate"), rnd("avgKDA"),
        rnd("avgGoldEarned"), rnd("avgVisionScore"), rnd("avgDamagePerMin"), rnd("avgDamageTakenPerMin"),
    )


def _combo_query(nested: DataFrame, n1: str, n2: str, exploded: bool) -> DataFrame:
    flat = _explode_modes(nested, ["puuid", "year", n1, n2])
    if exploded:
        return flat.select("puuid", "year", n1, n2, "gameMode", F.posexplode("champions").alias("pos", "c")).select(
            "puuid", "year", n1, n2, "gameMode", (F.col("pos") + 1).alias("rank"),
            F.col("c.championName").alias("championName"), F.col("c.gamesPlayed").alias("gamesPlayed"),
        )
    top = F.array_join(
        F.transform("champions", lambda c: F.concat(c["championName"], F.lit(":"), c["gamesPlayed"].cast("string"))),
        "|",
    )
    return flat.select(
        "puuid", "year", n1, n2, "gameMode", "comboCount", rnd("winRate"), rnd("avgKDA"), top.alias("topChampions")
    )


@register("e08_e11_spell_stats")
def spell_query(spark, sf_dir):
    """Ordered spell pair x mode stats with the top-5 champions."""
    dims, feat = _setup(spark, sf_dir)
    return _combo_query(su.spell_summary(su.spell_stats(feat, dims)), "spell1Name", "spell2Name", False)


@register("e09_spell_top5")
def spell_top5_query(spark, sf_dir):
    """Top-5 champions per spell pair x mode, one row per rank."""
    dims, feat = _setup(spark, sf_dir)
    return _combo_query(su.spell_summary(su.spell_stats(feat, dims)), "spell1Name", "spell2Name", True)


@register("e12_e14_rune_stats")
def rune_query(spark, sf_dir):
    """Rune style pair x mode stats with the top-5 champions."""
    dims, feat = _setup(spark, sf_dir)
    return _combo_query(su.rune_summary(su.rune_stats(feat, dims)), "primaryStyle", "subStyle", False)


@register("e13_rune_top5")
def rune_top5_query(spark, sf_dir):
    """Top-5 champions per rune pair x mode, one row per rank."""
    dims, feat = _setup(spark, sf_dir)
    return _combo_query(su.rune_summary(su.rune_stats(feat, dims)), "primaryStyle", "subStyle", True)


@register("e15_role_stats")
def role_query(spark, sf_dir):
    """Role x mode stats out of the nested role summary."""
    _, feat = _setup(spark, sf_dir)
    flat = _explode_modes(su.role_summary(su.role_stats(feat)), ["puuid", "year", "teamPosition"])
    return flat.select("puuid", "year", "teamPosition", "gameMode", "gamesPlayed", rnd("winRate"), rnd("avgKDA"))


@register("e16_hour_activity")
def hour_query(spark, sf_dir):
    """Games per hour x mode."""
    _, feat = _setup(spark, sf_dir)
    flat = _explode_modes(su.activity_summary(su.activity_stats(feat, "hour"), "hour"), ["puuid", "year", "hour"])
    return flat.select("puuid", "year", "hour", "gameMode", "gamesPlayed")


@register("e17_month_activity")
def month_query(spark, sf_dir):
    """Games per month (of game creation) x mode."""
    _, feat = _setup(spark, sf_dir)
    flat = _explode_modes(su.activity_summary(su.activity_stats(feat, "month"), "month"), ["puuid", "year", "month"])
    return flat.select("puuid", "year", "month", "gameMode", "gamesPlayed")


@register("e18_e19_streak_runs")
def streak_runs_query(spark, sf_dir):
    """Every streak of every player-year."""
    _, feat = _setup(spark, sf_dir)
    runs = st.streak_runs(feat)
    return runs.select(
        "puuid", "year", "streakLength", "isWinStreak", secs("startDate").alias("startTs"), secs("endDate").alias("endTs")
    )


def _longest_flat(longest: DataFrame, k1: str, k2: str, unit) -> DataFrame:
    w, lo = "longestWinStreak.", "longestLoseStreak."
    return longest.select(
        k1, k2,
        F.col(w + "length").alias("winLength"), unit(F.col(w + "startDate")).alias("winStart"),
        unit(F.col(w + "endDate")).alias("winEnd"),
        F.col(lo + "length").alias("loseLength"), unit(F.col(lo + "startDate")).alias("loseStart"),
        unit(F.col(lo + "endDate")).alias("loseEnd"),
    )


@register("e20_e22_longest_streaks")
def longest_query(spark, sf_dir):
    """Longest win / lose streak per player-year (0 when none)."""
    _, feat = _setup(spark, sf_dir)
    return _longest_flat(st.longest_streaks(st.streak_runs(feat)), "puuid", "year", F.unix_seconds)


@register("e18_e22_event_streaks")
def event_streaks_query(spark, sf_dir):
    """E18-E22 on the event stream: a user's events with value >= 20 are wins."""
    ev = binding.table(spark, sf_dir, "events").select(
        "user_id",
        F.year("ts").alias("year"),
        F.col("ts").cast("timestamp").alias("gameDate"),
        F.col("event_id").alias("matchId"),
        (F.col("value") >= 20).alias("win"),
    )
    keys = ("user_id", "year")
    return _longest_flat(st.longest_streaks(st.streak_runs(ev, keys), keys), "user_id", "year", F.unix_micros)


@register("e23_global_totals")
def totals_query(spark, sf_dir):
    """Totals per player-year."""
    _, feat = _setup(spark, sf_dir)
    return su.global_totals(feat).select(
        "puuid", "year", "totalGames", "totalWins", rnd("totalHoursPlayed"), rnd("winRate")
    )


@register("e24_mode_stats")
def mode_query(spark, sf_dir):
    """Per-mode stats per player-year."""
    _, feat = _setup(spark, sf_dir)
    m = su.mode_stats(feat)
    return m.select(
        "puuid", "year", "gameMode", "gamesPlayed", rnd("winRate"), rnd("avgKDA"), rnd("avgCSperMin"),
        rnd("avgDamagePerMin"), rnd("avgDamageTakenPerMin"), rnd("avgGameDuration"), "highestGold", "highestVision",
    )


def _document_counts(docs: DataFrame) -> DataFrame:
    s = "document.summary."
    n = lambda c: F.size(F.col(s + c)).cast("long")
    return docs.select(
        "puuid", "year",
        F.col(s + "global.totalGames").alias("totalGames"),
        n("champions").alias("nChampions"), n("roles").alias("nRoles"), n("items").alias("nItems"),
        n("spells").alias("nSpells"), n("runes").alias("nRunes"), n("activityByHour").alias("nHours"),
        n("activityByMonth").alias("nMonths"), n("global.modes").alias("nModes"),
        F.col(s + "global.longestWinStreak.length").alias("winLength"),
        F.col(s + "global.longestLoseStreak.length").alias("loseLength"),
    )


@register("e25_e26_documents")
def documents_query(spark, sf_dir):
    """The assembled document per player-year, checked by its section sizes."""
    dims, feat = _setup(spark, sf_dir)
    return _document_counts(doc.build_documents(feat, dims, stage_input=True))


# ---------------------------------------------------------------- F
@register("f01_f02_chunks")
def chunks_query(spark, sf_dir):
    """F1-F2: 300-token chunks with 20 % overlap over whole documents, keys attached."""
    from seasonlens.operators.retrieval import chunk_documents

    docs = binding.table(spark, sf_dir, "documents")
    ch = chunk_documents(docs, "doc_id", "text", keep=("lang",))
    return ch.select("chunk_id", "doc_id", "lang", "chunkNo", "nTokens", "text")


@register("f03_vector_topk")
def topk_query(spark, sf_dir):
    """top-15 by cosine to each label's centroid, filtered to equal label."""
    from seasonlens.operators.retrieval import centroids, vector_topk

    emb = binding.table(spark, sf_dir, "embeddings")
    q = centroids(emb, "label", "embedding").select(
        F.col("label").alias("query_id"), "label", F.col("centroid").alias("query_vec")
    )
    corpus = emb.select(F.col("vec_id").alias("doc_id"), "label", "embedding")
    top = vector_topk(q, corpus, ["label"], k=15, rank_digits=R)
    return top.select("label", "rank", F.col("doc_id").alias("vec_id"), rnd("score"))


@register("f01_f03_document_retrieval")
def document_retrieval_query(spark, sf_dir):
    """A14 -> F1 -> F2 -> F3: stored text documents indexed per (puuid, year), a third of the players' first with outdated texts and then
    replaced; the three chunks nearest to each player-year's query among its own."""
    from seasonlens.operators import chunk_index as ix
    from seasonlens.session import scratch_path
    from seasonlens.sources.matches import read_text_documents

    store, path = scratch_path(spark, "season_texts"), scratch_path(spark, "chunk_index")
    binding.season_texts(spark, sf_dir).select(F.to_json(F.struct("puuid", "year", "text", "ask")).alias("value")).write.text(store)
    docs = read_text_documents(spark, store).select(
        F.from_json("value", "puuid long, year int, text string, ask string").alias("d")).select("d.*")
    changed = F.col("puuid") % 3 == 0
    ix.replace_documents(docs.withColumn("text", F.when(changed, F.concat("text", F.lit(" old "), "text")).otherwise(F.col("text"))), path)
    ix.replace_documents(docs.where(changed), path, buckets=8)
    asked = docs.select(F.col("puuid").cast("string").alias("puuid"), "year", F.concat_ws("_", "puuid", "year").alias("query_id"),
                        ix.term_vector("ask").alias("query_vec"))
    found = ix.search(ix.read_index(spark, path), asked, k=3, rank_digits=R)
    return found.select("puuid", "year", "rank", "chunk_id", rnd("score"))


@register("f04_json_extract")
def json_extract_query(spark, sf_dir):
    """JSON array recovered from free text, with the failure reason."""
    from pyspark.sql import types as T

    from seasonlens.functions.text import extract_json_array

    t = binding.json_texts(spark, sf_dir)
    r = t.select("event_id", extract_json_array("text", T.StructType([T.StructField("k", T.LongType())])).alias("r"))
    return r.select(
        "event_id", F.col("r.status").alias("status"),
        F.when(F.col("r.value").isNotNull(), F.size("r.value").cast("long")).alias("nElements"),
        F.try_element_at("r.value", F.lit(1))["k"].alias("firstK"),
    )


# ---------------------------------------------------------------- G
@register("g01_g02_progress_fold")
def progress_query(spark, sf_dir):
    """G1: display state and percent of every job after all its messages."""
    from seasonlens.streaming.progress import progress_fold

    msgs = binding.progress_messages(spark, sf_dir)
    return progress_fold(msgs, "job", "seq").select(
        F.col("job").alias("user_id"), "state", "count", "total", "percent", "label", "messages"
    )


@register("g04_g05_answer_score")
def score_query(spark, sf_dir):
    """First answer per question, score and tier per player."""
    from seasonlens.operators.scoring import score

    ans = binding.answers(spark, sf_dir)
    facts = ans.select("player", "question").distinct().withColumn("correct_answer", F.lit(1).cast("long"))
    out = score(ans, facts, order=("ts", "event_id"))
    return out.select(F.col("player").alias("user_id"), "answered", "correct", "total", "tier")


# ---------------------------------------------------------------- B
def _extracted(spark, sf_dir):
    from seasonlens.operators import ingest

    rows = ingest.extract_player_rows(binding.raw_matches(spark, sf_dir))
    return ingest.split_malformed(rows)


@register("b01_b04_extract")
def extract_query(spark, sf_dir):
    """B1-B4 (+B11): every player's row out of the nested match documents."""
    valid, _ = _extracted(spark, sf_dir)
    return valid.select(
        "puuid", "matchId", "gameCreation", "gameDuration", "championName", "kills", "deaths", "assists", "win",
        F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("itemsText"),
        "summoner1Id", "summoner2Id",
        F.col("perks.primaryStyle").alias("primaryStyle"), F.col("perks.subStyle").alias("subStyle"),
        F.col("perks.primaryPerk").alias("primaryPerk"), "year", "month_part", "day_part",
    )


@register("b05_quarantine")
def quarantine_query(spark, sf_dir):
    """Every kind of malformed input, from raw JSON lines: broken lines, matches without id, participants or
    start time, participants without their rune styles; each with its reason."""
    from seasonlens.operators import ingest

    matches, broken = ingest.read_raw_matches(spark, _raw_lines(spark, sf_dir))
    _, bad = ingest.split_malformed(ingest.extract_player_rows(matches))
    return bad.unionByName(broken)


def _raw_lines(spark, sf_dir):
    """The raw matches as JSON lines, some spoilt by their order key, and one broken line for each event type."""
    from seasonlens.session import scratch_path

    path = scratch_path(spark, "raw_matches")
    raw = binding.raw_matches(spark, sf_dir)
    k = F.substring("metadata.matchId", 2, 20).cast("long")
    info = F.col("info")
    spoilt = raw.select(
        F.struct(F.when(k % 11 != 0, F.col("metadata.matchId")).alias("matchId")).alias("metadata"),
        info.withField("participants", F.when(k % 13 != 1, info["participants"]))
        .withField("gameStartTimestamp", F.when(k % 17 != 2, info["gameStartTimestamp"])).alias("info"))
    broken = binding.table(spark, sf_dir, "events").select(F.concat(F.lit("{broken "), "event_type").alias("value")).distinct()
    spoilt.select(F.to_json(F.struct("metadata", "info")).alias("value")).unionByName(broken).write.option("compression", "gzip").text(path)
    return path


@register("b08_b10_ingest_rerun")
def ingest_rerun_query(spark, sf_dir):
    """The ingest job run twice on the same raw lines; the table holds every valid player row once."""
    from seasonlens.jobs import ingest_job
    from seasonlens.session import scratch_path
    from seasonlens.sources.matches import read_player_matches

    raw, table = _raw_lines(spark, sf_dir), scratch_path(spark, "ingested")
    for _ in range(2):
        ingest_job(spark, raw, table, year=1997)
    return read_player_matches(spark, table).select("puuid", "matchId", "championName", "kills", "win", "year", "month_part", "day_part")


@register("b07_stored_ids")
def stored_ids_query(spark, sf_dir):
    """Ids of stored matches out of their object paths, distinct."""
    from seasonlens.operators import ingest

    m = binding.stored_match_keys(spark, sf_dir)
    path = F.format_string("store/history/%s/stats/%d/%02d/%02d/%s.json", F.col("puuid").cast("string"), "year", "month_part", "day_part", "matchId")
    return ingest.stored_ids_from_paths(m.select(path.alias("path")))


@register("b07_listed_ids")
def listed_ids_query(spark, sf_dir):
    """Ids of the stored one-document files, from their listing; no file is opened."""
    from seasonlens.operators import ingest
    from seasonlens.sources.matches import list_date_path_files

    return ingest.stored_ids_from_paths(list_date_path_files(spark, _date_path_store(spark, sf_dir)))


@register("b20_default_year")
def default_year_query(spark, sf_dir):
    """The year a request without one asks for, as of the request's time."""
    from seasonlens.operators.requests import default_year

    return binding.table(spark, sf_dir, "events").select("event_id", default_year(as_of=F.col("ts")).alias("year"))


@register("b06_b11_year_window")
def year_window_query(spark, sf_dir):
    """Games started inside 1998 (UTC, both ends inclusive) and their date keys."""
    from seasonlens.operators import ingest

    rows = binding.player_matches_with_start(spark, sf_dir)
    return ingest.in_year(rows, 1998).select("puuid", "matchId", "year", "month_part", "day_part")


@register("b07_b08_new_matches")
def new_matches_query(spark, sf_dir):
    """Candidate matches not stored yet (anti-join on puuid, matchId)."""
    from seasonlens.operators import ingest

    cand = binding.player_matches(spark, sf_dir).select("puuid", "matchId")
    return ingest.new_matches(cand, binding.stored_match_keys(spark, sf_dir))


@register("b09_g03_completeness")
def completeness_query(spark, sf_dir):
    """Listed vs stored matches per player-year."""
    from seasonlens.operators import ingest

    expected = binding.player_matches(spark, sf_dir)
    return ingest.completeness(expected, binding.stored_match_keys(spark, sf_dir))


@register("b10_upsert")
def upsert_query(spark, sf_dir):
    """Idempotent write, last version of a (puuid, matchId) wins."""
    from seasonlens.operators import ingest

    m = binding.player_matches(spark, sf_dir)
    part = F.element_at(F.split("matchId", "_"), 3).cast("long")
    old = m.where(part % 2 == 0).select("puuid", "matchId", "kills", F.lit(1).alias("version"))
    new = m.where(part % 3 == 0).select("puuid", "matchId", (F.col("kills") + 100).alias("kills"), F.lit(2).alias("version"))
    return ingest.upsert(old, new, "version").select("puuid", "matchId", "kills", "version")


@register("b12_b16_requests")
def requests_query(spark, sf_dir):
    """Normalise, validate, split, encode and route every request."""
    from seasonlens.operators.requests import parse_requests

    out = parse_requests(binding.requests(spark, sf_dir))
    return out.select(
        "c_custkey", "handle", "region_code", "status", "error", "game_name", "tag_line", "routing_value",
        "account_routing", "region_label",
    )


@register("b17_b19_routes")
def routes_query(spark, sf_dir):
    """Existence flags, route and the running-work guard per player-year."""
    from seasonlens.operators.requests import guard_running, route, work_flags

    keys = binding.player_matches(spark, sf_dir).select("puuid", "year").distinct()
    summaries = keys.where(F.col("puuid") % 2 == 0)
    finals = keys.where(F.col("puuid") % 4 == 0)
    running = keys.where(F.col("puuid") % 3 == 0)
    work = work_flags(keys, summaries, finals).withColumn("route", route())
    return guard_running(work, running).select("puuid", "year", "summary_exists", "final_exists", "route", "action")


# ---------------------------------------------------------------- A
@register("a01_a04_json_roundtrip")
def json_roundtrip_query(spark, sf_dir):
    """A4 then A1-A2: date-partitioned JSON write of every row, read back with a schema."""
    from pyspark.sql import types as T

    from seasonlens.session import scratch_path
    from seasonlens.sources.matches import read_player_matches, write_player_matches

    path = scratch_path(spark, "player_matches_json")
    write_player_matches(binding.player_matches(spark, sf_dir), path, fmt="json")
    back = read_player_matches(spark, path, fmt="json", puuid_type=T.LongType())
    return back.select(
        "puuid", "matchId", "year", "month_part", "day_part", "gameCreation", "kills", "win",
        F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("itemsText"),
        F.col("perks.primaryStyle").alias("primaryStyle"),
    )


@register("a01_date_path_scan")
def date_path_query(spark, sf_dir):
    """A1-A2 on one-document files: every usable document with a declared schema, and every other file with its reason."""
    return _date_path_scan(spark, sf_dir, infer=False)


@register("a02_inferred_quarantine")
def inferred_quarantine_query(spark, sf_dir):
    """A1-A2 on the same files with the schema inferred from them."""
    return _date_path_scan(spark, sf_dir, infer=True)


def _date_path_store(spark, sf_dir) -> str:
    from seasonlens.session import scratch_path
    from seasonlens.sources.matches import write_date_path_documents

    root = scratch_path(spark, "match_files")
    write_date_path_documents(binding.date_path_documents(spark, sf_dir), root)
    return root


def _date_path_scan(spark, sf_dir, infer):
    from seasonlens.sources.matches import read_date_path_documents

    rows, bad = read_date_path_documents(spark, _date_path_store(spark, sf_dir), infer=infer)
    file = F.format_string("%s/stats/%d/%02d/%02d/%s.json", "puuid", "year", "month_part", "day_part", "matchId")
    good = rows.select(
        file.alias("file"), "matchId", "gameCreation", "championName", "kills", "win",
        F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("itemsText"),
        F.col("perks.primaryStyle").alias("primaryStyle"), F.lit(None).cast("string").alias("reason"))
    return good.unionByName(
        bad.select(F.array_join(F.slice(F.split("path", "/"), -6, 6), "/").alias("file"), "reason"), allowMissingColumns=True)


@register("a03_year_scoped_read")
def scoped_read_query(spark, sf_dir):
    """A3: one year read from the partitioned parquet table (folders pruned)."""
    from seasonlens.session import scratch_path
    from seasonlens.sources.matches import read_player_matches, scoped, write_player_matches

    path = scratch_path(spark, "player_matches_parquet")
    write_player_matches(binding.player_matches(spark, sf_dir), path)
    return scoped(read_player_matches(spark, path), year=1998).select(
        "puuid", "matchId", "year", "month_part", "day_part"
    )


@register("a05_item_catalogue")
def item_catalogue_query(spark, sf_dir):
    """Both item catalogue versions written as documents ``{"data": {"<id>": {"name": ...}}}`` of at most 1000
    items each, read back and merged, latest first."""
    from seasonlens.functions.lookup import merge_item_versions
    from seasonlens.session import scratch_path
    from seasonlens.sources import dims as D

    part = binding.table(spark, sf_dir, "part").select("p_partkey", "p_name")
    versions = {
        "latest": part.where("p_partkey % 3 <> 0").withColumn("p_name", F.expr("case when p_partkey % 50 = 0 then '' else p_name end")),
        "first": part.where("p_partkey % 5 <> 0"),
    }
    base = scratch_path(spark, "item_docs")
    for name, items in versions.items():
        entry = F.struct(F.col("p_partkey").cast("string"), F.struct(F.col("p_name").alias("name")))
        docs = items.groupBy(F.expr("p_partkey div 1000").alias("part_no")).agg(F.map_from_entries(F.collect_list(entry)).alias("data"))
        docs.repartition("part_no").write.partitionBy("part_no").json(f"{base}/{name}")
    return merge_item_versions(D.read_items(spark, f"{base}/latest"), D.read_items(spark, f"{base}/first"))


@register("a06_a08_dimension_docs")
def dimension_docs_query(spark, sf_dir):
    """Spell / rune-style / queue documents written in the published
    shapes (map keyed by name, array, array) and read back to (id, name)."""
    from seasonlens.session import scratch_path
    from seasonlens.sources import dims as D

    base = scratch_path(spark, "dimension_docs")
    nation = binding.table(spark, sf_dir, "nation")
    spell_doc = nation.agg(
        F.map_from_entries(F.collect_list(F.struct(
            F.col("n_name"),
            F.struct(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("name")),
        ))).alias("data")
    )
    spell_doc.coalesce(1).write.json(f"{base}/spells")
    # Rune styles and queues are published as one JSON array per file.
    binding.table(spark, sf_dir, "region").agg(
        F.to_json(F.collect_list(F.struct(F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name"))))
    ).coalesce(1).write.text(f"{base}/runes")
    binding.literal_rows(spark, binding.QUEUE_ROWS, "queueId bigint, map string, description string, notes string").agg(
        F.to_json(F.collect_list(F.struct("queueId", "map", "description", "notes")))
    ).coalesce(1).write.text(f"{base}/queues")
    return (
        D.read_spells(spark, f"{base}/spells").select(F.lit("spell").alias("kind"), "id", "name")
        .unionByName(D.read_rune_styles(spark, f"{base}/runes").select(F.lit("rune").alias("kind"), "id", "name"))
        .unionByName(D.read_queues(spark, f"{base}/queues").select(F.lit("queue").alias("kind"), "id", "name"))
    )


@register("a09_a11_a14_document_sink")
def document_sink_query(spark, sf_dir):
    """A9-A11 then A14: documents + sidecar written as JSON lines, read back as text."""
    from seasonlens.session import scratch_path

    dims, feat = _setup(spark, sf_dir)
    path = scratch_path(spark, "documents")
    doc.write_summaries(feat, dims, path)
    return _stored_documents(spark, path)


def _stored_documents(spark, path):
    """Stored documents with their sidecar, as plain columns."""
    j = F.get_json_object
    columns = [
        j("value", "$.playerPUUID").cast("long").alias("_player"),
        j("value", "$.summary.global.totalGames").cast("long").alias("totalGames"),
        F.json_array_length(j("value", "$.summary.champions")).cast("long").alias("nChampions"),
        j("value", "$.summary.global.longestWinStreak.length").cast("long").alias("winLength"),
        j("value", "$.summary.global.longestWinStreak.startDate").alias("winStart"),
    ]
    return doc.read_documents(spark, path, columns=columns).select(
        F.col("_player").alias("puuid"), j("meta", "$.metadataAttributes.year").cast("int").alias("year"),
        j("meta", "$.doc_key").alias("docKey"), "totalGames", "nChampions", "winLength", "winStart",
    )


@register("a09_scoped_rerun")
def scoped_rerun_query(spark, sf_dir):
    """All documents written, a third of the players written again from their games since June only, by a run that asks for
    another number of buckets; every other player-year must still be stored, and each once."""
    from seasonlens.session import scratch_path

    dims, feat = _setup(spark, sf_dir)
    path = scratch_path(spark, "documents")
    doc.write_summaries(feat, dims, path)
    some = feat.where((F.col("puuid") % 3 == 0) & (F.col("month") >= 6))
    doc.write_summaries(some, dims, path, buckets=8)
    return _stored_documents(spark, path).select("puuid", "year", "docKey", "totalGames", "nChampions")


# ---------------------------------------------------------------- F5-F7
def _facts(spark, sf_dir):
    from seasonlens.operators.facts import FACT_COLUMNS, fact_candidates

    from seasonlens.session import stage

    _, feat = _setup(spark, sf_dir)
    # read by the fact numbers and the streaks; clustered by key, so that partial aggregates leave few rows
    feat = stage(feat.select("puuid", "year", *FACT_COLUMNS, "gameDate", "matchId").hint("rebalance", "puuid", "year")
                 .sortWithinPartitions("puuid", "year", "gameDate"), "fact_features")
    longest = st.longest_streaks(st.streak_runs(feat, bucket_seconds=st.LONG_BUCKET, chunking="time"))
    return fact_candidates(feat, longest)


@register("f06_f07_fact_candidates")
def facts_query(spark, sf_dir):
    """The ten deterministic fact kinds per player-year, choices shuffled stably."""
    return _facts(spark, sf_dir).select(
        "puuid", "year", "kind", "question", "fact", F.col("correct_answer").alias("correctAnswer"),
        F.array_join("choices", "|").alias("choicesText"),
    )


@register("f05_fact_validation")
def facts_validation_query(spark, sf_dir):
    """fact arrays per player-year checked (10 facts, answer among choices); some are broken first:
    by player, a wrong answer, a missing fact, no choices, a missing question."""
    from seasonlens.operators.facts import nest_facts, validate_facts

    p = F.col("puuid") % 6
    first = F.col("facts")[0]
    spoilt = (
        F.when(p == 1, first.withField("correct_answer", F.lit("nobody")))
        .when(p == 3, first.withField("choices", F.array().cast("array<string>")))
        .when(p == 4, first.withField("question", F.lit(None).cast("string"))).otherwise(first))
    rest = F.slice("facts", 2, F.when(p == 2, F.size("facts") - 2).otherwise(F.size("facts") - 1))
    broken = nest_facts(_facts(spark, sf_dir)).withColumn("facts", F.concat(F.array(spoilt), rest))
    return validate_facts(broken).select("puuid", "year", "nFacts", "nValid", "ok")


@register("a12_a13_facts_roundtrip")
def facts_roundtrip_query(spark, sf_dir):
    """Facts written per player-year, read back for the finished keys only."""
    from pyspark.sql import types as T

    from seasonlens.operators.facts import nest_facts
    from seasonlens.session import scratch_path
    from seasonlens.sources.sinks import read_facts, write_facts

    path = scratch_path(spark, "facts")
    nested = nest_facts(_facts(spark, sf_dir))
    write_facts(nested, path)
    finished = spark.read.parquet(path).select("puuid", "year").where(F.col("puuid") % 4 == 0)
    back = read_facts(spark, path, finished, puuid_type=T.LongType())
    return back.select(
        "puuid", "year", F.size("facts").cast("long").alias("nFacts"),
        F.col("facts")[0]["correct_answer"].alias("firstAnswer"),
    )


@register("a12_scoped_rerun")
def facts_rerun_query(spark, sf_dir):
    """All facts written, a third of the players written again with their first fact only;
    every key is read back."""
    from pyspark.sql import types as T

    from seasonlens.operators.facts import nest_facts
    from seasonlens.session import scratch_path
    from seasonlens.sources.sinks import read_facts, write_facts

    path = scratch_path(spark, "facts")
    write_facts(nest_facts(_facts(spark, sf_dir)), path)
    again = read_facts(spark, path, puuid_type=T.LongType()).where(F.col("puuid") % 3 == 0)
    write_facts(again.select("puuid", "year", F.slice("facts", 1, 1).alias("facts")), path, buckets=5)
    return read_facts(spark, path, puuid_type=T.LongType()).select(
        "puuid", "year", F.size("facts").cast("long").alias("nFacts"), F.col("facts")[0]["correct_answer"].alias("firstAnswer"))


# ---------------------------------------------------------------- streams
@register("g01_progress_stream")
def progress_stream_query(spark, sf_dir):
    """G1-G2 streamed: messages as JSON text files (availableNow), each batch's partial fold appended; returns
    the merged display states."""
    from seasonlens.streaming.runners import read_progress

    return read_progress(spark, _progress_streams(spark, sf_dir)[0]).select(
        F.col("job").alias("user_id"), "state", "count", "total", "percent", "label", "messages"
    )


@register("g02_quarantine_stream")
def progress_quarantine_query(spark, sf_dir):
    """G2 streamed: the malformed lines that the progress stream set aside."""
    return spark.read.parquet(_progress_streams(spark, sf_dir)[1]).select("value")


def _progress_streams(spark, sf_dir):
    """Runs both progress streams over all messages and a broken line of each event type; (partial rows, quarantine)."""
    from pyspark.sql import types as T

    from seasonlens.session import scratch_path
    from seasonlens.streaming.runners import progress_stream

    src, out, bad, ck = (scratch_path(spark, n) for n in ("progress_src", "progress_out", "progress_bad", "progress_ck"))
    msgs = binding.progress_messages(spark, sf_dir).withColumn("seq", F.struct("seq.ts", "seq.event_id"))
    as_json = msgs.select(F.to_json(F.struct("job", "seq", "state", "total", "count")).alias("value"))
    # One broken line per event type keeps the quarantine path exercised.
    broken = binding.table(spark, sf_dir, "events").select(F.concat(F.lit("{broken "), "event_type").alias("value")).distinct()
    as_json.unionByName(broken).write.text(src)
    seq_type = T.StructType([T.StructField("ts", T.TimestampNTZType()), T.StructField("event_id", T.LongType())])
    for q in progress_stream(spark, src, out, bad, ck, seq_type=seq_type):
        q.awaitTermination()
    return out, bad


@register("g06_duplicate_guard_stream")
def guard_stream_query(spark, sf_dir):
    """Requests (one per event: user, year) arriving in time order, slice by slice; a repeat of a
    (user, year) within 30 minutes of the last accepted one is refused."""
    return _guarded(spark, sf_dir, slices=3)


def _guarded(spark, sf_dir, slices):
    """The log arrives in ``slices`` appends; the stream takes up what is new after each and resumes from its checkpoint."""
    from seasonlens.session import scratch_path
    from seasonlens.streaming.runners import guarded_requests

    src, out, ck = (scratch_path(spark, n) for n in ("guard_src", "guard_out", "guard_ck"))
    req = binding.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("puuid"), F.year("ts").alias("year"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    span = req.agg(F.min(F.unix_micros("ts")).alias("lo"), F.max(F.unix_micros("ts")).alias("hi")).first()
    lo, width = span["lo"] or 0, ((span["hi"] or 0) - (span["lo"] or 0)) // slices + 1
    for i in range(slices):
        us = F.unix_micros("ts")
        req.where((us >= lo + i * width) & (us < lo + (i + 1) * width)).write.mode("append").parquet(src)
        stream = spark.readStream.schema(req.schema).parquet(src)
        (
            guarded_requests(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
            .trigger(availableNow=True).start().awaitTermination()
        )
    return spark.read.schema(req.schema).parquet(out).select("puuid", "year", "event_id")


@register("g07_incremental_refresh")
def refresh_query(spark, sf_dir):
    """The stored table streamed into a foreachBatch refresh of touched player-years; the newest document per key, checked by its section sizes.

    A fifth of the players are first stored with wrong champions and no items; their matches are then corrected (same games, same times) and refreshed
    by a stream that has lost its checkpoint, so only the version tells the right document."""
    from seasonlens.session import scratch_path
    from seasonlens.sources.matches import write_player_matches
    from seasonlens.streaming.runners import latest_documents, refresh_stream

    table, out, ck = (scratch_path(spark, n) for n in ("refresh_table", "refresh_docs", "refresh_ck"))
    dims = binding.dimensions(spark, sf_dir)
    matches = binding.player_matches(spark, sf_dir)
    wrong = F.col("puuid") % 5 == 0
    write_player_matches(matches.withColumns({
        "championName": F.when(wrong, F.lit("?")).otherwise(F.col("championName")),
        "items": F.when(wrong, F.array().cast(matches.schema["items"].dataType)).otherwise(F.col("items"))}), table)
    refresh_stream(spark, table, out, ck, dims).awaitTermination()
    write_player_matches(matches, table)
    refresh_stream(spark, table, out, scratch_path(spark, "refresh_ck"), dims).awaitTermination()
    j = F.get_json_object
    n = lambda p: F.json_array_length(j("summary_json", p)).cast("long")
    return latest_documents(spark, out, columns=[
        j("summary_json", "$.summary.global.totalGames").cast("long").alias("totalGames"),
        n("$.summary.champions").alias("nChampions"), n("$.summary.roles").alias("nRoles"),
        n("$.summary.items").alias("nItems"), n("$.summary.spells").alias("nSpells"),
        n("$.summary.runes").alias("nRunes"), n("$.summary.activityByHour").alias("nHours"),
        n("$.summary.activityByMonth").alias("nMonths"), n("$.summary.global.modes").alias("nModes"),
        j("summary_json", "$.summary.global.longestWinStreak.length").cast("long").alias("winLength"),
        j("summary_json", "$.summary.global.longestLoseStreak.length").cast("long").alias("loseLength"),
    ])
