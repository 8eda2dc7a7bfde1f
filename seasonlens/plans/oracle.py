"""DuckDB SQL for each registered query (the correctness oracle).

Each statement runs on the driver's pre-registered views (``lineitem``,
``orders``, ...).  ``BASE`` rebuilds the binding (``m``), the dimensions and
the feature table ``f`` in plain SQL, independently of the Spark code.
Doubles are rounded to 6 places and times are epoch numbers on both sides.
"""

from __future__ import annotations

R = 6  # rounding of every double in query outputs

_M = """
m AS (
  SELECT cast(o_custkey // 30 AS BIGINT) AS puuid,
    concat_ws('_', l_orderkey, l_linenumber, l_partkey, l_suppkey,
              cast(round(l_extendedprice*100) AS BIGINT)) AS match_id,
    date_diff('day', timestamp '1970-01-01', l_shipdate)*86400000
      + (l_partkey*7919 + l_suppkey*104729 + l_linenumber*1299709) % 86400000 AS game_creation,
    date_diff('day', timestamp '1970-01-01', l_shipdate)*86400000
      + (l_partkey*7919 + l_suppkey*104729 + l_linenumber*1299709) % 86400000
      + l_linenumber*60000 AS game_start,
    CASE WHEN l_partkey % 97 = 0 THEN 0 ELSE cast(l_quantity AS BIGINT)*36 + 900 END AS game_duration,
    cast(substr(o_orderpriority, 1, 1) AS BIGINT) AS queue_id,
    p_brand AS champion,
    CASE WHEN p_type = 'SMALL' THEN '' ELSE p_type END AS team_position,
    l_partkey % 15 AS kills, l_suppkey % 9 AS deaths, l_orderkey % 21 AS assists,
    l_partkey % 300 AS minions, l_suppkey % 60 AS neutral, l_orderkey % 15000 AS gold,
    l_partkey*13 % 40000 AS dmg, l_suppkey*17 % 35000 AS taken, l_orderkey % 60 AS vision,
    l_quantity >= 20 AS win,
    [l_partkey % 40, l_suppkey % 40, l_orderkey % 40, l_partkey % 7, l_suppkey % 7,
     cast(0 AS BIGINT), l_orderkey % 3] AS items,
    l_suppkey % 27 AS spell1, (l_partkey + l_linenumber) % 27 AS spell2,
    l_suppkey % 6 AS rune1, l_partkey % 6 AS rune2,
    l_partkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
)"""

_DIMS = """
qraw(id, map, description, notes) AS (VALUES
  (1, 'Map A', NULL::VARCHAR, NULL::VARCHAR), (2, 'Map A', 'Ranked', NULL::VARCHAR),
  (3, 'Map B', NULL::VARCHAR, 'old'), (4, 'Map B', 'Draft', 'v2')),
q AS (
  SELECT id, CASE WHEN description IS NULL AND notes IS NULL THEN map
                  WHEN notes IS NULL THEN map || ': ' || description
                  WHEN description IS NULL THEN map || ' (' || notes || ')'
                  ELSE map || ': ' || description || ' (' || notes || ')' END AS label
  FROM qraw),
il AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 50 = 0 THEN '' ELSE p_name END AS name
       FROM part WHERE p_partkey % 3 <> 0),
io AS (SELECT p_partkey AS id, p_name AS name FROM part WHERE p_partkey % 5 <> 0),
idim AS (SELECT coalesce(il.id, io.id) AS id,
                coalesce(nullif(il.name, ''), nullif(io.name, '')) AS name
         FROM il FULL OUTER JOIN io ON il.id = io.id)"""

_F = """
f AS (
  SELECT m.*,
    cast(year(epoch_ms(game_start)) AS INTEGER) AS year,
    game_creation // 1000 AS ts,
    cast(month(epoch_ms((game_creation // 1000) * 1000)) AS INTEGER) AS month,
    cast(hour(epoch_ms((game_creation // 1000) * 1000)) AS INTEGER) AS hour,
    cast(dayofweek(epoch_ms((game_creation // 1000) * 1000)) + 1 AS INTEGER) AS day_of_week,
    CASE WHEN game_duration = 0 THEN NULL ELSE (minions + neutral) / (game_duration / 60) END AS cs_per_min,
    (kills + assists) / (CASE WHEN deaths = 0 THEN 1 ELSE deaths END) AS kda,
    CASE WHEN game_duration = 0 THEN NULL ELSE dmg / (game_duration / 60) END AS dmg_per_min,
    CASE WHEN game_duration = 0 THEN NULL ELSE taken / (game_duration / 60) END AS taken_per_min,
    game_duration / 3600 AS hours_played,
    coalesce(q.label, cast(queue_id AS VARCHAR)) AS game_mode,
    CASE WHEN win THEN 1 ELSE 0 END AS w
  FROM m LEFT JOIN q ON q.id = m.queue_id
)"""


def spell_name(col: str) -> str:
    return f"coalesce((SELECT n_name FROM nation WHERE n_nationkey = {col}), cast({col} AS VARCHAR))"


def rune_name(col: str) -> str:
    return f"coalesce((SELECT r_name FROM region WHERE r_regionkey = {col}), cast({col} AS VARCHAR))"


def item_name(col: str) -> str:
    return f"coalesce(nullif((SELECT name FROM idim WHERE idim.id = {col}), ''), cast({col} AS VARCHAR))"


BASE = "WITH " + ",".join([_M, _DIMS, _F])


def with_base(*extra_ctes: str) -> str:
    """``WITH m, dims, f [, extra ...]`` prefix."""
    return BASE + "".join("," + c for c in extra_ctes)


ORACLE: dict[str, str] = {}

ORACLE["c01_c10_features"] = with_base() + f"""
SELECT puuid, year, match_id AS matchId, ts AS gameTs, month, hour, day_of_week AS dayOfWeek,
  round(cs_per_min, {R}) AS csPerMin, round(kda, {R}) AS kda, round(dmg_per_min, {R}) AS dmgPerMin,
  round(taken_per_min, {R}) AS dmgTakenPerMin, round(hours_played, {R}) AS hoursPlayed,
  game_mode AS gameMode
FROM f"""

ORACLE["d01_item_names"] = with_base() + """
SELECT p_partkey AS itemId, """ + item_name("p_partkey") + """ AS itemName FROM part"""

ORACLE["a05_item_catalogue"] = with_base() + """
SELECT id, name FROM idim"""

ORACLE["d02_d04_names"] = with_base() + f"""
SELECT match_id AS matchId, {spell_name('spell1')} AS spell1Name, {spell_name('spell2')} AS spell2Name,
  {rune_name('rune1')} AS primaryStyle, {rune_name('rune2')} AS subStyle, game_mode AS gameMode
FROM f"""

ORACLE["e01_e04_champion_stats"] = with_base(
    f"""
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY puuid, year, champion, game_mode
                               ORDER BY kda DESC NULLS LAST, ts DESC, match_id DESC) AS rn
  FROM f),
stats AS (
  SELECT puuid, year, champion, game_mode, count(*) AS games, avg(w) AS win_rate,
         avg(kda) AS avg_kda, avg(cs_per_min) AS avg_cs
  FROM f GROUP BY puuid, year, champion, game_mode)"""
) + f"""
SELECT s.puuid, s.year, s.champion AS championName, s.game_mode AS gameMode, s.games AS gamesPlayed,
  round(s.win_rate, {R}) AS winRate, round(s.avg_kda, {R}) AS avgKDA, round(s.avg_cs, {R}) AS avgCSperMin,
  r.kills AS bestKills, r.deaths AS bestDeaths, r.assists AS bestAssists, round(r.kda, {R}) AS bestKda,
  r.win AS bestWin, r.ts AS bestGameTs, r.game_mode AS bestGameMode,
  {rune_name('r.rune1')} AS bestPrimaryRune, {rune_name('r.rune2')} AS bestSecondaryRune,
  {spell_name('r.spell1')} AS bestSpell1, {spell_name('r.spell2')} AS bestSpell2
FROM stats s JOIN ranked r
  ON r.rn = 1 AND r.puuid = s.puuid AND r.year = s.year AND r.champion = s.champion AND r.game_mode = s.game_mode"""

ORACLE["e05_e07_item_stats"] = with_base(
    """
slots AS (SELECT f.*, unnest(items) AS item_id FROM f)"""
) + f"""
SELECT puuid, year, {item_name('item_id')} AS itemName, game_mode AS gameMode, count(*) AS usageCount,
  round(avg(w), {R}) AS winRate, round(avg(kda), {R}) AS avgKDA, round(avg(gold), {R}) AS avgGoldEarned,
  round(avg(vision), {R}) AS avgVisionScore, round(avg(dmg_per_min), {R}) AS avgDamagePerMin,
  round(avg(taken_per_min), {R}) AS avgDamageTakenPerMin
FROM slots WHERE item_id <> 0
GROUP BY puuid, year, item_id, game_mode"""


def _combo_sql(a: str, b: str, name_fn, n1: str, n2: str, exploded: bool) -> str:
    ctes = with_base(
        f"""
fine AS (
  SELECT puuid, year, {a} AS id1, {b} AS id2, game_mode, champion, count(*) AS n
  FROM f GROUP BY puuid, year, {a}, {b}, game_mode, champion),
top AS (
  SELECT *, row_number() OVER (PARTITION BY puuid, year, id1, id2, game_mode
                               ORDER BY n DESC, champion ASC) AS rk
  FROM fine),
stats AS (
  SELECT puuid, year, {a} AS id1, {b} AS id2, game_mode, count(*) AS combo_count,
         avg(w) AS win_rate, avg(kda) AS avg_kda
  FROM f GROUP BY puuid, year, {a}, {b}, game_mode)"""
    )
    if exploded:
        return ctes + f"""
SELECT puuid, year, {name_fn('id1')} AS {n1}, {name_fn('id2')} AS {n2}, game_mode AS gameMode,
  cast(rk AS INTEGER) AS rank, champion AS championName, n AS gamesPlayed
FROM top WHERE rk <= 5"""
    return ctes + f""",
champs AS (
  SELECT puuid, year, id1, id2, game_mode,
         string_agg(champion || ':' || cast(n AS VARCHAR), '|' ORDER BY rk) AS top_champions
  FROM top WHERE rk <= 5 GROUP BY puuid, year, id1, id2, game_mode)
SELECT s.puuid, s.year, {name_fn('s.id1')} AS {n1}, {name_fn('s.id2')} AS {n2}, s.game_mode AS gameMode,
  s.combo_count AS comboCount, round(s.win_rate, {R}) AS winRate, round(s.avg_kda, {R}) AS avgKDA,
  c.top_champions AS topChampions
FROM stats s JOIN champs c USING (puuid, year, id1, id2, game_mode)"""


ORACLE["e08_e11_spell_stats"] = _combo_sql("spell1", "spell2", spell_name, "spell1Name", "spell2Name", False)
ORACLE["e09_spell_top5"] = _combo_sql("spell1", "spell2", spell_name, "spell1Name", "spell2Name", True)
ORACLE["e12_e14_rune_stats"] = _combo_sql("rune1", "rune2", rune_name, "primaryStyle", "subStyle", False)
ORACLE["e13_rune_top5"] = _combo_sql("rune1", "rune2", rune_name, "primaryStyle", "subStyle", True)

ORACLE["e15_role_stats"] = with_base() + f"""
SELECT puuid, year, team_position AS teamPosition, game_mode AS gameMode, count(*) AS gamesPlayed,
  round(avg(w), {R}) AS winRate, round(avg(kda), {R}) AS avgKDA
FROM f GROUP BY puuid, year, team_position, game_mode"""

ORACLE["e16_hour_activity"] = with_base() + """
SELECT puuid, year, hour, game_mode AS gameMode, count(*) AS gamesPlayed
FROM f GROUP BY puuid, year, hour, game_mode"""

ORACLE["e17_month_activity"] = with_base() + """
SELECT puuid, year, month, game_mode AS gameMode, count(*) AS gamesPlayed
FROM f GROUP BY puuid, year, month, game_mode"""

_STREAK_CTES = """
chg AS (
  SELECT *, CASE WHEN win <> lag(win) OVER (PARTITION BY k1, k2 ORDER BY t, tie) THEN 1 ELSE 0 END AS c
  FROM g),
grp AS (
  SELECT *, sum(c) OVER (PARTITION BY k1, k2 ORDER BY t, tie
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sg
  FROM chg),
runs AS (
  SELECT k1, k2, sg, count(*) AS len, bool_or(win) AS is_win, min(t) AS st, max(t) AS en
  FROM grp GROUP BY k1, k2, sg),
keys AS (SELECT DISTINCT k1, k2 FROM g),
bw AS (
  SELECT k1, k2, len, st, en FROM (
    SELECT *, row_number() OVER (PARTITION BY k1, k2 ORDER BY len DESC, st ASC, en ASC) AS rn
    FROM runs WHERE is_win) WHERE rn = 1),
bl AS (
  SELECT k1, k2, len, st, en FROM (
    SELECT *, row_number() OVER (PARTITION BY k1, k2 ORDER BY len DESC, st ASC, en ASC) AS rn
    FROM runs WHERE NOT is_win) WHERE rn = 1)"""

_LONGEST_SELECT = """
SELECT keys.k1 AS {k1}, keys.k2 AS {k2},
  coalesce(bw.len, 0) AS winLength, bw.st AS winStart, bw.en AS winEnd,
  coalesce(bl.len, 0) AS loseLength, bl.st AS loseStart, bl.en AS loseEnd
FROM keys LEFT JOIN bw USING (k1, k2) LEFT JOIN bl USING (k1, k2)"""

_GAMES_M = "g AS (SELECT puuid AS k1, year AS k2, ts AS t, match_id AS tie, win FROM f)"

ORACLE["e18_e19_streak_runs"] = with_base(_GAMES_M, _STREAK_CTES) + """
SELECT k1 AS puuid, k2 AS year, len AS streakLength, is_win AS isWinStreak, st AS startTs, en AS endTs
FROM runs"""

ORACLE["e20_e22_longest_streaks"] = with_base(_GAMES_M, _STREAK_CTES) + _LONGEST_SELECT.format(
    k1="puuid", k2="year"
)

ORACLE["e18_e22_event_streaks"] = (
    "WITH g AS (SELECT user_id AS k1, cast(year(ts) AS INTEGER) AS k2, epoch_us(ts) AS t, "
    "event_id AS tie, value >= 20 AS win FROM events),"
    + _STREAK_CTES
    + _LONGEST_SELECT.format(k1="user_id", k2="year")
)

ORACLE["e23_global_totals"] = with_base() + f"""
SELECT puuid, year, count(*) AS totalGames, cast(sum(w) AS BIGINT) AS totalWins,
  round(sum(hours_played), {R}) AS totalHoursPlayed, round(sum(w) / count(*), {R}) AS winRate
FROM f GROUP BY puuid, year"""

ORACLE["e24_mode_stats"] = with_base() + f"""
SELECT puuid, year, game_mode AS gameMode, count(*) AS gamesPlayed, round(avg(w), {R}) AS winRate,
  round(avg(kda), {R}) AS avgKDA, round(avg(cs_per_min), {R}) AS avgCSperMin,
  round(avg(dmg_per_min), {R}) AS avgDamagePerMin, round(avg(taken_per_min), {R}) AS avgDamageTakenPerMin,
  round(avg(game_duration), {R}) AS avgGameDuration, max(gold) AS highestGold, max(vision) AS highestVision
FROM f GROUP BY puuid, year, game_mode"""

ORACLE["e25_e26_documents"] = with_base(
    _GAMES_M,
    _STREAK_CTES,
    """
slots AS (SELECT puuid, year, item_id, game_mode FROM (SELECT f.*, unnest(items) AS item_id FROM f)
          WHERE item_id <> 0),
item_names AS (SELECT DISTINCT puuid, year, """ + item_name("item_id") + """ AS nm FROM slots)""",
) + """
SELECT puuid, year, count(*) AS totalGames,
  cast(count(DISTINCT (champion, game_mode)) AS BIGINT) AS nChampions,
  cast(count(DISTINCT team_position) AS BIGINT) AS nRoles,
  (SELECT count(*) FROM item_names i WHERE i.puuid = f.puuid AND i.year = f.year) AS nItems,
  cast(count(DISTINCT (""" + spell_name("spell1") + ", " + spell_name("spell2") + """)) AS BIGINT) AS nSpells,
  cast(count(DISTINCT (""" + rune_name("rune1") + ", " + rune_name("rune2") + """)) AS BIGINT) AS nRunes,
  cast(count(DISTINCT hour) AS BIGINT) AS nHours,
  cast(count(DISTINCT month) AS BIGINT) AS nMonths,
  cast(count(DISTINCT game_mode) AS BIGINT) AS nModes,
  (SELECT coalesce(max(len), 0) FROM runs WHERE runs.k1 = f.puuid AND runs.k2 = f.year AND is_win) AS winLength,
  (SELECT coalesce(max(len), 0) FROM runs WHERE runs.k1 = f.puuid AND runs.k2 = f.year AND NOT is_win) AS loseLength
FROM f GROUP BY puuid, year"""



# ------------------------------------------------------------------ F
ORACLE["f01_f02_chunks"] = """
WITH w AS (
  SELECT doc_id, lang, list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda x: x <> '') AS words
  FROM documents),
c AS (SELECT doc_id, lang, words, len(words) AS n FROM w WHERE len(words) > 0),
s AS (
  SELECT doc_id, lang, words,
         unnest(range(0, (n + 239) // 240)) AS chunk_no
  FROM c)
SELECT doc_id || '-' || chunk_no AS chunk_id, doc_id, lang, cast(chunk_no AS INTEGER) AS chunkNo,
  cast(len(list_slice(words, chunk_no*240 + 1, chunk_no*240 + 300)) AS INTEGER) AS nTokens,
  array_to_string(list_slice(words, chunk_no*240 + 1, chunk_no*240 + 300), ' ') AS text
FROM s"""

ORACLE["f03_vector_topk"] = f"""
WITH e AS (SELECT vec_id, label, cast(embedding AS DOUBLE[]) AS v FROM embeddings),
cells AS (SELECT label, unnest(range(1, len(v) + 1)) AS pos, unnest(v) AS x FROM e),
cen AS (
  SELECT label, list(a ORDER BY pos) AS c
  FROM (SELECT label, pos, avg(x) AS a FROM cells GROUP BY label, pos) GROUP BY label),
sc AS (
  SELECT e.label, e.vec_id,
         list_dot_product(c, v) / (sqrt(list_dot_product(c, c)) * sqrt(list_dot_product(v, v))) AS score
  FROM e JOIN cen USING (label)),
rk AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(score, {R}) DESC, vec_id) AS rn
  FROM sc)
SELECT label, cast(rn AS INTEGER) AS rank, vec_id, round(score, {R}) AS score FROM rk WHERE rn <= 15"""

ORACLE["f01_f03_document_retrieval"] = with_base(f"""
d AS (
  SELECT puuid, year, max(champion) || ' won' AS ask,
    string_agg(champion || ' ' || team_position || ' ' || CASE WHEN win THEN 'won' ELSE 'lost' END, ' ' ORDER BY game_creation, match_id) AS text
  FROM f GROUP BY puuid, year),
wd AS (
  SELECT puuid, year, list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda x: x <> '') AS words,
    list_filter(regexp_split_to_array(ask, '[ \t\r\n]+'), lambda x: x <> '') AS asked FROM d),
ch AS (SELECT puuid, year, words, asked, unnest(range(0, (len(words) + 239) // 240)) AS no FROM wd),
pl AS (
  SELECT puuid, year, no, list_transform(asked, lambda x: cast('0x' || substr(md5(x), 1, 4) AS INTEGER) % 64) AS qb,
    list_transform(list_slice(words, no*240 + 1, no*240 + 300), lambda x: cast('0x' || substr(md5(x), 1, 4) AS INTEGER) % 64) AS cb FROM ch),
ve AS (
  SELECT puuid, year, no, list_transform(range(0, 64), lambda i: cast(len(list_filter(qb, lambda x: x = i)) AS DOUBLE)) AS q,
    list_transform(range(0, 64), lambda i: cast(len(list_filter(cb, lambda x: x = i)) AS DOUBLE)) AS c FROM pl),
sc AS (
  SELECT puuid, year, concat(puuid, '_', year, '-', no) AS chunk_id,
    list_dot_product(q, c) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(c, c))) AS score FROM ve),
rk AS (SELECT *, row_number() OVER (PARTITION BY puuid, year ORDER BY round(score, {R}) DESC, chunk_id) AS rn FROM sc)""") + f"""
SELECT cast(puuid AS VARCHAR) AS puuid, year, cast(rn AS INTEGER) AS rank, chunk_id, round(score, {R}) AS score FROM rk WHERE rn <= 3"""

ORACLE["f04_json_extract"] = r"""
WITH t AS (
  SELECT event_id,
    CASE event_id % 6 WHEN 0 THEN '[' || props || ']'
                      WHEN 1 THEN 'Here: [' || props || '] done'
                      WHEN 2 THEN 'No list, only ' || props
                      WHEN 3 THEN props
                      WHEN 4 THEN '[1, ' || props || ']'
                      ELSE 'Here: [' || props || '; ] done' END AS text
  FROM events),
p AS (
  SELECT event_id, text, regexp_extract(text, '(?s)\[.*\]', 0) AS span,
         coalesce(CASE WHEN json_valid(text) THEN json_type(text) = 'ARRAY' END, false) AS whole_ok
  FROM t),
q AS (SELECT *, coalesce(CASE WHEN json_valid(span) THEN json_type(span) = 'ARRAY' END, false) AS span_ok FROM p),
s AS (
  SELECT event_id,
    CASE WHEN event_id % 6 = 4 THEN 'bad_array' WHEN whole_ok THEN 'whole' WHEN span = '' THEN 'no_array' WHEN span_ok THEN 'extracted'
         ELSE 'bad_array' END AS status,
    CASE WHEN event_id % 6 = 4 THEN NULL WHEN whole_ok THEN text WHEN span_ok THEN span END AS js
  FROM q)
SELECT event_id, status, cast(json_array_length(js) AS BIGINT) AS nElements,
  cast(json_extract(js, '$[0].k') AS BIGINT) AS firstK
FROM s"""

# ------------------------------------------------------------------ G
_MSG = """
msg AS (
  SELECT user_id AS job, ts, event_id,
    CASE event_type WHEN 'signup' THEN 'START_RETRIEVE_MATCH' WHEN 'view' THEN 'RETRIEVING_MATCH'
      WHEN 'click' THEN 'PROCESSING_MATCH' WHEN 'error' THEN 'GENERATING_FACTS'
      WHEN 'purchase' THEN 'COMPLETE' END AS state,
    CASE WHEN event_type = 'signup' THEN cast(100 AS BIGINT) END AS total,
    cast(floor(value) AS BIGINT) AS cnt
  FROM events)"""

ORACLE["g01_g02_progress_fold"] = "WITH " + _MSG + """,
k AS (SELECT * FROM msg WHERE state IN ('BUSY', 'FAIL', 'START_RETRIEVE_MATCH', 'RETRIEVING_MATCH',
                                        'PROCESSING_MATCH', 'GENERATING_FACTS', 'COMPLETE')),
lst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY ts DESC, event_id DESC) AS rn
                       FROM k) WHERE rn = 1),
st AS (SELECT job, total AS start_total
       FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY ts DESC, event_id DESC) AS rn
             FROM k WHERE state = 'START_RETRIEVE_MATCH') WHERE rn = 1),
n AS (SELECT job, count(*) AS messages FROM k GROUP BY job),
j AS (SELECT lst.job, lst.state, lst.cnt, lst.total AS own_total, st.start_total, n.messages,
             coalesce(nullif(st.start_total, 0), nullif(lst.total, 0), 1) AS used_total
      FROM lst LEFT JOIN st USING (job) JOIN n USING (job))
SELECT job AS user_id, state, cnt AS count, cast(used_total AS BIGINT) AS total,
  cast(CASE state WHEN 'RETRIEVING_MATCH' THEN least(5 + floor(cnt / used_total * 70 + 0.5), 75)
                  WHEN 'START_RETRIEVE_MATCH' THEN 5 WHEN 'PROCESSING_MATCH' THEN 75
                  WHEN 'GENERATING_FACTS' THEN 90 WHEN 'COMPLETE' THEN 100 ELSE 0 END AS BIGINT) AS percent,
  CASE state WHEN 'RETRIEVING_MATCH' THEN 'Collecting shards: ' || coalesce(cast(cast(cnt AS BIGINT) AS VARCHAR), '') || ' / ' || cast(used_total AS BIGINT)
             WHEN 'START_RETRIEVE_MATCH' THEN 'Peering into ' || cast(used_total AS BIGINT) || ' echoes...'
             WHEN 'PROCESSING_MATCH' THEN 'Distilling patterns from the chaos...'
             WHEN 'GENERATING_FACTS' THEN 'Assembling enchanted trivia...' WHEN 'COMPLETE' THEN 'Finalizing your chronicle...' END AS label,
  messages
FROM j"""

ORACLE["g04_g05_answer_score"] = """
WITH a AS (
  SELECT user_id, event_type, cast(floor(value) AS BIGINT) % 4 AS choice,
         row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn
  FROM events),
fa AS (SELECT user_id, choice FROM a WHERE rn = 1),
g AS (SELECT user_id, count(choice) AS answered, count(CASE WHEN choice = 1 THEN 1 END) AS correct,
             count(*) AS total FROM fa GROUP BY user_id)
SELECT user_id, answered, correct, total,
  CASE WHEN correct = total THEN 'all_correct' WHEN correct >= total / 2 THEN 'half_or_more'
       ELSE 'below_half' END AS tier
FROM g"""

# ------------------------------------------------------------------ B
_RAW = """
li AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey
                               ORDER BY l_linenumber, l_partkey, round(l_extendedprice*100)) AS rn,
    date_diff('day', timestamp '1970-01-01', o_orderdate)*86400000 + (o_orderkey*7919) % 86400000 AS created
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""

ORACLE["b01_b04_extract"] = "WITH " + _RAW + """
SELECT cast(l_suppkey AS VARCHAR) AS puuid, 'M' || o_orderkey AS matchId, created AS gameCreation,
  900 + o_orderkey % 1800 AS gameDuration, p_brand AS championName,
  l_partkey % 15 AS kills, l_suppkey % 9 AS deaths, l_orderkey % 21 AS assists, l_quantity >= 20 AS win,
  array_to_string([l_partkey % 40, l_suppkey % 40, l_orderkey % 40, l_partkey % 7, l_suppkey % 7, 0,
                   l_orderkey % 3], ',') AS itemsText,
  l_suppkey % 27 AS summoner1Id, (l_partkey + l_linenumber) % 27 AS summoner2Id,
  l_suppkey % 6 AS primaryStyle, l_partkey % 6 AS subStyle, (l_suppkey % 6)*1000 + l_linenumber AS primaryPerk,
  cast(year(epoch_ms(created + 60000)) AS INTEGER) AS year,
  cast(month(epoch_ms(created + 60000)) AS INTEGER) AS month_part,
  cast(day(epoch_ms(created + 60000)) AS INTEGER) AS day_part
FROM li WHERE rn = 1 AND l_linenumber <> 7"""

_SPOILT = _RAW + """,
sp AS (SELECT *, CASE WHEN o_orderkey % 11 <> 0 THEN 'M' || o_orderkey END AS match_id,
         CASE WHEN o_orderkey % 11 = 0 THEN 'missing matchId' WHEN l_linenumber = 7 THEN 'missing rune styles'
              WHEN o_orderkey % 17 = 2 THEN 'missing start time' END AS reason
       FROM li WHERE rn = 1 AND o_orderkey % 13 <> 1)"""

ORACLE["b05_quarantine"] = "WITH " + _SPOILT + """
SELECT cast(l_suppkey AS VARCHAR) AS puuid, match_id AS matchId, reason FROM sp WHERE reason IS NOT NULL
UNION ALL
SELECT DISTINCT NULL, CASE WHEN o_orderkey % 11 <> 0 THEN 'M' || o_orderkey END, 'missing participants' FROM (SELECT DISTINCT o_orderkey FROM li)
WHERE o_orderkey % 13 = 1 AND o_orderkey % 11 <> 0
UNION ALL
SELECT NULL, NULL, 'missing participants' FROM (SELECT DISTINCT o_orderkey FROM li) WHERE o_orderkey % 13 = 1 AND o_orderkey % 11 = 0
UNION ALL
SELECT NULL, NULL, 'broken document' FROM (SELECT DISTINCT event_type FROM events)"""

ORACLE["b08_b10_ingest_rerun"] = "WITH " + _SPOILT + """
SELECT cast(l_suppkey AS VARCHAR) AS puuid, match_id AS matchId, p_brand AS championName, l_partkey % 15 AS kills, l_quantity >= 20 AS win,
  cast(year(epoch_ms(created + 60000)) AS INTEGER) AS year, cast(month(epoch_ms(created + 60000)) AS INTEGER) AS month_part,
  cast(day(epoch_ms(created + 60000)) AS INTEGER) AS day_part
FROM sp WHERE reason IS NULL AND year(epoch_ms(created + 60000)) = 1997"""

ORACLE["b07_stored_ids"] = with_base() + """
SELECT DISTINCT cast(puuid AS VARCHAR) AS puuid, match_id AS matchId FROM m WHERE l_partkey % 2 = 0"""

_FILES = """
fl AS (
  SELECT *, cast(split_part(match_id, '_', 1) AS BIGINT) AS k, concat(puuid, '/stats/', strftime(epoch_ms(game_start), '%Y/%m/%d/'), match_id, '.json') AS file
  FROM m QUALIFY row_number() OVER (PARTITION BY split_part(match_id, '_', 1) ORDER BY match_id DESC) = 1)"""

ORACLE["b07_listed_ids"] = with_base(_FILES) + """
SELECT cast(puuid AS VARCHAR) AS puuid, match_id AS matchId FROM fl"""

ORACLE["b20_default_year"] = "SELECT event_id, cast(year(ts) - 1 AS INTEGER) AS year FROM events"

ORACLE["b06_b11_year_window"] = with_base() + """
SELECT puuid, match_id AS matchId, cast(year(epoch_ms(game_start)) AS INTEGER) AS year,
  cast(month(epoch_ms(game_start)) AS INTEGER) AS month_part,
  cast(day(epoch_ms(game_start)) AS INTEGER) AS day_part
FROM m
WHERE game_start // 1000 BETWEEN date_diff('second', timestamp '1970-01-01', timestamp '1998-01-01 00:00:00')
                            AND date_diff('second', timestamp '1970-01-01', timestamp '1998-12-31 23:59:59')"""

ORACLE["b07_b08_new_matches"] = with_base() + """
SELECT puuid, match_id AS matchId FROM m
WHERE NOT EXISTS (SELECT 1 FROM m s WHERE s.l_partkey % 2 = 0 AND s.puuid = m.puuid AND s.match_id = m.match_id)"""

ORACLE["b09_g03_completeness"] = with_base(
    "st AS (SELECT DISTINCT puuid, year, match_id FROM f WHERE l_partkey % 2 = 0)"
) + """
SELECT e.puuid, e.year, e.expected, coalesce(s.stored, 0) AS stored, coalesce(s.stored, 0) = e.expected AS complete
FROM (SELECT puuid, year, count(DISTINCT match_id) AS expected FROM f GROUP BY puuid, year) e
LEFT JOIN (SELECT puuid, year, count(*) AS stored FROM st GROUP BY puuid, year) s USING (puuid, year)"""

ORACLE["b10_upsert"] = with_base(
    "old AS (SELECT puuid, match_id, kills, 1 AS version FROM m WHERE l_partkey % 2 = 0)",
    "new AS (SELECT puuid, match_id, kills + 100 AS kills, 2 AS version FROM m WHERE l_partkey % 3 = 0)",
) + """
SELECT coalesce(n.puuid, o.puuid) AS puuid, coalesce(n.match_id, o.match_id) AS matchId,
  coalesce(n.kills, o.kills) AS kills, coalesce(n.version, o.version) AS version
FROM old o FULL OUTER JOIN new n ON o.puuid = n.puuid AND o.match_id = n.match_id"""


def _values(d: dict[str, str]) -> str:
    return ", ".join(f"('{k}', '{v}')" for k, v in d.items())


# Fixed values, written out here so that a wrong value in the engine shows.
ROUTING = {
    "na1": "americas", "br1": "americas", "la1": "americas", "la2": "americas",
    "euw1": "europe", "eun1": "europe", "tr1": "europe", "ru": "europe",
    "kr": "asia", "jp1": "asia",
    "oc1": "sea", "sg2": "sea", "tw2": "sea", "vn2": "sea",
}
REGION_LABELS = {
    "na1": "NA", "euw1": "EUW", "eun1": "EUNE", "kr": "KR", "br1": "BR", "la1": "LAN", "la2": "LAS",
    "oc1": "OCE", "tr1": "TR", "ru": "RU", "jp1": "JP", "sg2": "SG", "tw2": "TW", "vn2": "VN",
}
ERR_REQUIRED = 'Riot ID is required (e.g., GameName#TAG)'
ERR_FORMAT = 'Please use Riot ID format: GameName#TAG (e.g., Hide on bush#KR1)'
REGION_CODES = ['na1', 'euw1', 'eun1', 'KR', 'br1', ' la1', 'la2', 'oc1', 'tr1', 'ru', 'jp1', 'sg2', 'tw2', 'ph2', 'th2', '']


def _requests_sql() -> str:
    codes = "[" + ", ".join(f"'{c}'" for c in REGION_CODES) + "]"
    return f"""
WITH c AS (SELECT c_custkey, c_name, c_nationkey, c_custkey % 10 AS v FROM customer),
r AS (
  SELECT c_custkey,
    CASE WHEN v = 0 THEN NULL WHEN v = 1 THEN '' WHEN v = 2 THEN replace(c_name, '#', ' ')
         WHEN v = 3 THEN '  ' || c_name || ' ' WHEN v = 4 THEN substr(c_name, 1, 4) || ' ' || substr(c_name, 5)
         WHEN v = 5 THEN c_name || '#x/y' ELSE c_name END AS riot,
    CASE WHEN v = 0 THEN c_name WHEN v = 1 THEN '' END AS summ,
    CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE ({codes})[c_nationkey % 16 + 1] END AS region
  FROM c),
n AS (
  SELECT c_custkey, trim(coalesce(nullif(riot, ''), nullif(summ, ''), '')) AS handle,
         lower(trim(coalesce(nullif(region, ''), 'na1'))) AS region_code
  FROM r),
v AS (SELECT *, handle <> '' AND strpos(handle, '#') > 0 AS ok FROM n),
rt(code, grp) AS (VALUES {_values(ROUTING)}),
lb(code, label) AS (VALUES {_values(REGION_LABELS)}),
x AS (SELECT v.*, coalesce(rt.grp, 'americas') AS routing, lb.label FROM v
      LEFT JOIN rt ON rt.code = v.region_code LEFT JOIN lb ON lb.code = lower(v.region_code))
SELECT c_custkey, handle, region_code,
  CASE WHEN ok THEN 200 ELSE 400 END AS status,
  CASE WHEN handle = '' THEN '{ERR_REQUIRED}' WHEN NOT ok THEN '{ERR_FORMAT}' END AS error,
  CASE WHEN ok THEN replace(url_encode(split_part(handle, '#', 1)), '%2F', '/') END AS game_name,
  CASE WHEN ok THEN replace(url_encode(substr(handle, strpos(handle, '#') + 1)), '%2F', '/') END AS tag_line,
  CASE WHEN ok THEN routing END AS routing_value,
  CASE WHEN ok THEN (CASE WHEN routing = 'sea' THEN 'asia' ELSE routing END) END AS account_routing,
  CASE WHEN region_code IS NULL OR region_code = '' THEN '' ELSE coalesce(label, upper(region_code)) END
    AS region_label
FROM x"""


ORACLE["b12_b16_requests"] = _requests_sql()

ORACLE["b17_b19_routes"] = with_base("k AS (SELECT DISTINCT puuid, year FROM f)") + """
SELECT puuid, year, puuid % 2 = 0 AS summary_exists, puuid % 4 = 0 AS final_exists,
  CASE WHEN puuid % 4 = 0 THEN 'facts_only_read' WHEN puuid % 2 = 0 THEN 'facts_from_summary'
       ELSE 'full_run' END AS route,
  CASE WHEN NOT (puuid % 2 = 0 AND puuid % 4 = 0) AND puuid % 3 = 0 THEN 'BUSY' ELSE 'START' END AS action
FROM k"""



# ------------------------------------------------------------------ A
ORACLE["a01_a04_json_roundtrip"] = with_base() + """
SELECT puuid, match_id AS matchId, cast(year(epoch_ms(game_start)) AS INTEGER) AS year,
  cast(month(epoch_ms(game_start)) AS INTEGER) AS month_part, cast(day(epoch_ms(game_start)) AS INTEGER) AS day_part,
  game_creation AS gameCreation, kills, win, array_to_string(items, ',') AS itemsText, rune1 AS primaryStyle
FROM m"""

ORACLE["a01_date_path_scan"] = with_base(_FILES, """
t AS (SELECT *, CASE WHEN k % 53 = 1 THEN 'unparsable' WHEN k % 61 = 3 OR k % 67 = 4 THEN 'no document'
                     WHEN k % 59 = 2 THEN 'missing matchId' END AS reason FROM fl)""") + """
SELECT file, match_id AS matchId, game_creation AS gameCreation, champion AS championName, kills, win,
  array_to_string(items, ',') AS itemsText, rune1 AS primaryStyle, reason
FROM t WHERE reason IS NULL
UNION ALL
SELECT file, NULL, NULL, NULL, NULL, NULL, NULL, NULL, reason FROM t WHERE reason IS NOT NULL"""
ORACLE["a02_inferred_quarantine"] = ORACLE["a01_date_path_scan"]

ORACLE["a03_year_scoped_read"] = with_base() + """
SELECT puuid, match_id AS matchId, cast(year(epoch_ms(game_start)) AS INTEGER) AS year,
  cast(month(epoch_ms(game_start)) AS INTEGER) AS month_part, cast(day(epoch_ms(game_start)) AS INTEGER) AS day_part
FROM m WHERE year(epoch_ms(game_start)) = 1998"""

ORACLE["a06_a08_dimension_docs"] = with_base() + """
SELECT 'spell' AS kind, cast(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation
UNION ALL SELECT 'rune', cast(r_regionkey AS BIGINT), r_name FROM region
UNION ALL SELECT 'queue', cast(id AS BIGINT), label FROM q"""

ORACLE["a09_a11_a14_document_sink"] = with_base(_GAMES_M, _STREAK_CTES) + """
SELECT f.puuid, f.year, count(*) AS totalGames, cast(count(DISTINCT (champion, game_mode)) AS BIGINT) AS nChampions,
  any_value(coalesce(bw.len, 0)) AS winLength,
  any_value(strftime(epoch_ms(bw.st * 1000), '%Y-%m-%dT%H:%M:%S')) AS winStart,
  'summary/' || f.puuid || '/final_summary_' || f.year || '.json' AS docKey
FROM f LEFT JOIN bw ON bw.k1 = f.puuid AND bw.k2 = f.year
GROUP BY f.puuid, f.year"""


# ------------------------------------------------------------------ F5-F7
def _shuffle_sql(lst: str, kind: str) -> str:
    seed = f"cast(puuid AS VARCHAR) || '|' || cast(year AS VARCHAR) || '|{kind}|'"
    return (
        f"array_to_string(list_transform(list_sort(list_transform({lst}, lambda c: md5({seed} || c) || '|' || c)), "
        f"lambda s: substr(s, 34)), '|')"
    )


def _cat_sql(no: int, kind: str, label: str, sort: str, fact: str, question: str) -> str:
    return f"""
c{no} AS (
  SELECT puuid, year, lbl, n, row_number() OVER (PARTITION BY puuid, year ORDER BY n DESC, srt ASC) AS r
  FROM (SELECT puuid, year, {label} AS lbl, {sort} AS srt, count(*) AS n FROM f GROUP BY puuid, year, lbl, srt)),
k{no} AS (
  SELECT puuid, year, '{kind}' AS kind, {question} AS question,
    printf('{fact}', max(CASE WHEN r = 1 THEN lbl END), max(CASE WHEN r = 1 THEN n END)) AS fact,
    max(CASE WHEN r = 1 THEN lbl END) AS correctAnswer,
    {_shuffle_sql("list(lbl ORDER BY r)", kind)} AS choicesText
  FROM c{no} WHERE r <= 4 GROUP BY puuid, year)"""


def _num_sql(no: int, kind: str, value: str, offsets: list[str], fact: str, question: str) -> str:
    lst = "[" + ", ".join(f"cast({e} AS VARCHAR)" for e in ["v", *offsets]) + "]"
    return f"""
k{no} AS (
  SELECT puuid, year, '{kind}' AS kind, {question} AS question, printf('{fact}', v) AS fact,
    cast(v AS VARCHAR) AS correctAnswer, {_shuffle_sql(lst, kind)} AS choicesText
  FROM (SELECT puuid, year, {value} AS v FROM pk) WHERE v IS NOT NULL)"""


_FACT_CTES = [
    _GAMES_M,
    _STREAK_CTES,
    _cat_sql(1, "most_played_champion", "champion", "champion",
             "You played %s more than any other champion: %d games.",
             "printf('Which champion did you play the most in %d?', year)"),
    _cat_sql(2, "favourite_role", "CASE WHEN team_position = '' THEN 'UNASSIGNED' ELSE team_position END",
             "CASE WHEN team_position = '' THEN 'UNASSIGNED' ELSE team_position END",
             "Your favourite role was %s with %d games.", "'Which role did you play the most?'"),
    _cat_sql(3, "busiest_month", "cast(month AS VARCHAR)", "month",
             "Your busiest month was month %s with %d games.", "'In which month did you play the most games?'"),
    _cat_sql(4, "most_played_mode", "game_mode", "game_mode",
             "Your most played mode was %s with %d games.", "'Which game mode did you play the most?'"),
    """
c5 AS (
  SELECT puuid, year, champion AS lbl, pct, n,
    row_number() OVER (PARTITION BY puuid, year ORDER BY pct DESC, n DESC, champion ASC) AS r
  FROM (SELECT puuid, year, champion, count(*) AS n, (sum(w) * 100) // count(*) AS pct
        FROM f GROUP BY puuid, year, champion HAVING count(*) >= 3)),
k5 AS (
  SELECT puuid, year, 'best_champion' AS kind, 'Which champion (3+ games) had your best win rate?' AS question,
    printf('Your best champion was %s with a %d%% win rate.', max(CASE WHEN r = 1 THEN lbl END),
           max(CASE WHEN r = 1 THEN pct END)) AS fact,
    max(CASE WHEN r = 1 THEN lbl END) AS correctAnswer,
    """ + _shuffle_sql("list(lbl ORDER BY r)", "best_champion") + """ AS choicesText
  FROM c5 WHERE r <= 4 GROUP BY puuid, year)""",
    """
k6 AS (
  SELECT keys.k1 AS puuid, keys.k2 AS year, 'longest_win_streak' AS kind,
    'True or false: your longest win streak was at least 5 games.' AS question,
    printf('Your longest win streak was %d games.', coalesce(bw.len, 0)) AS fact,
    CASE WHEN coalesce(bw.len, 0) >= 5 THEN 'True' ELSE 'False' END AS correctAnswer, 'True|False' AS choicesText
  FROM keys LEFT JOIN bw USING (k1, k2))""",
    """
pk AS (
  SELECT puuid, year, max(vision) AS vision, sum(assists) AS assists,
    min(CASE WHEN win AND game_duration > 0 THEN game_duration END) AS fastest,
    count(CASE WHEN hour >= 22 OR hour < 4 THEN 1 END) AS night, count(*) AS games
  FROM f GROUP BY puuid, year)""",
    _num_sql(7, "highest_vision", "vision", ["v + 7", "v + 14", "v + 21"],
             "Your highest vision score in one game was %d.", "'What was your highest vision score in a single game?'"),
    _num_sql(8, "total_assists", "cast(assists AS BIGINT)", ["v + v // 4 + 1", "v + v // 2 + 2", "v * 2 + 3"],
             "You made %d assists this year.", "printf('How many assists did you make in %d?', year)"),
    _num_sql(9, "fastest_win", "fastest // 60", ["v + 3", "v + 6", "v + 9"],
             "Your fastest win took %d minutes.", "'How many minutes did your fastest win last?'"),
    """
k10 AS (
  SELECT puuid, year, 'night_owl' AS kind,
    'True or false: more than a quarter of your games started between 22:00 and 04:00.' AS question,
    printf('%d of your %d games started between 22:00 and 04:00.', night, games) AS fact,
    CASE WHEN night * 4 > games THEN 'True' ELSE 'False' END AS correctAnswer, 'True|False' AS choicesText
  FROM pk)""",
    "allk AS (" + " UNION ALL ".join(
        f"SELECT {i} AS kind_no, puuid, year, kind, question, fact, correctAnswer, choicesText FROM k{i}"
        for i in range(1, 11)
    ) + ")",
]

ORACLE["f06_f07_fact_candidates"] = with_base(*_FACT_CTES) + """
SELECT puuid, year, kind, question, fact, correctAnswer, choicesText FROM allk"""

ORACLE["f05_fact_validation"] = with_base(*_FACT_CTES) + """
SELECT puuid, year, nFacts, nValid, nFacts = 10 AND nValid = 10 AS ok
FROM (SELECT puuid, year, count(*) - CASE WHEN puuid % 6 = 2 THEN 1 ELSE 0 END AS nFacts,
             count(*) - CASE WHEN puuid % 6 IN (1, 2, 3, 4) THEN 1 ELSE 0 END AS nValid
      FROM allk GROUP BY puuid, year)"""

ORACLE["a12_a13_facts_roundtrip"] = with_base(*_FACT_CTES) + """
SELECT puuid, year, count(*) AS nFacts, max(CASE WHEN kind_no = 1 THEN correctAnswer END) AS firstAnswer
FROM allk WHERE puuid % 4 = 0 GROUP BY puuid, year"""


ORACLE["a09_scoped_rerun"] = with_base() + """
SELECT puuid, year, count(*) AS totalGames, cast(count(DISTINCT (champion, game_mode)) AS BIGINT) AS nChampions,
  'summary/' || puuid || '/final_summary_' || year || '.json' AS docKey
FROM (SELECT *, puuid % 3 = 0 AND max(month) OVER (PARTITION BY puuid, year) >= 6 AS again FROM f)
WHERE NOT again OR month >= 6 GROUP BY puuid, year"""

ORACLE["a12_scoped_rerun"] = with_base(*_FACT_CTES) + """
SELECT puuid, year, CASE WHEN puuid % 3 = 0 THEN 1 ELSE count(*) END AS nFacts,
  max(CASE WHEN kind_no = 1 THEN correctAnswer END) AS firstAnswer
FROM allk GROUP BY puuid, year"""

# A request is accepted when its key had no accepted one in the 30 minutes before; a refused one changes nothing.
ORACLE["g06_duplicate_guard_stream"] = """
WITH RECURSIVE r AS (
  SELECT user_id AS puuid, cast(year(ts) AS INTEGER) AS year, ts, event_id,
         row_number() OVER (PARTITION BY user_id, year(ts) ORDER BY ts, event_id) AS i FROM events
), g AS (
  SELECT puuid, year, event_id, i, ts AS accepted_at, true AS accepted FROM r WHERE i = 1
  UNION ALL
  SELECT r.puuid, r.year, r.event_id, r.i,
         CASE WHEN r.ts >= g.accepted_at + INTERVAL 30 MINUTE THEN r.ts ELSE g.accepted_at END,
         r.ts >= g.accepted_at + INTERVAL 30 MINUTE
  FROM g JOIN r ON r.puuid = g.puuid AND r.year = g.year AND r.i = g.i + 1
)
SELECT puuid, year, event_id FROM g WHERE accepted"""

# Streaming forms return the same rows as their batch forms.
ORACLE["g01_progress_stream"] = ORACLE["g01_g02_progress_fold"]
ORACLE["g02_quarantine_stream"] = "SELECT DISTINCT '{broken ' || event_type AS value FROM events"
ORACLE["g07_incremental_refresh"] = ORACLE["e25_e26_documents"]


# Rounding nudge: engines sum in different orders, so an average whose exact
# value ends in 5 at the 7th decimal lands on either side of the tie.  Adding
# 1e-9 before rounding (on both sides) moves every such tie the same way.
NUDGE = 1e-9


def _nudge(sql: str) -> str:
    return sql.replace(f", {R})", f" + {NUDGE}, {R})")


ORACLE = {name: _nudge(sql) for name, sql in ORACLE.items()}
