"""The results of ``catalog.py`` in SQL (DuckDB dialect), written independently."""

from __future__ import annotations

from postpulse import constants as K
from postpulse.plans.catalog import ENTITIES, IMPORT_TIME, MORE_POLARITIES, SIZED_VIEWS


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _values(rows, names: str) -> str:
    body = ", ".join(
        "(" + ", ".join(
            "NULL" if v is None else _text(v) if isinstance(v, str) else f"{v}::DOUBLE"
            for v in row) + ")"
        for row in rows
    )
    return f"(SELECT * FROM (VALUES {body}) AS v({names}))"


NOW = f"TIMESTAMP '{IMPORT_TIME:%Y-%m-%d %H:%M:%S}'"
LEXICON = _values(K.LEXICON.items(), "word, polarity")
STOPWORDS = _values([(word,) for word in K.STOPWORDS], "word")
ENTITY_DICT = _values(ENTITIES, "entity, label")
SPACES = _text(K.SPACE_CHARS)

LOCATION = """CASE WHEN event_id % 13 = 0 THEN '' WHEN event_id % 17 = 0 THEN ' unknown '
 WHEN event_id % 19 = 0 THEN NULL WHEN c_mktsegment = 'BUILDING' THEN ' Atlantis'
 WHEN c_mktsegment = 'FURNITURE' THEN 'Nation ' || n_nationkey ELSE ' ' || lower(n_name) END"""

POSTS = f"""posts AS (
SELECT event_id, CAST(event_id AS VARCHAR) AS tweet_id,
 CASE WHEN event_id % 7 = 0 THEN 'RT @user_' || user_id || ': ' ELSE '' END || d.text ||
 CASE event_id % 4 WHEN 0 THEN ' great' WHEN 1 THEN ' terrible' WHEN 2 THEN ' not good bad'
  ELSE '' END ||
 ' #' || event_type ||
 CASE event_id % 3 WHEN 0 THEN ' #SparkDev' WHEN 1 THEN ' #spark' ELSE ' #Tech' END ||
 CASE WHEN event_id % 29 = 0 THEN ' Emergency' WHEN event_id % 31 = 0 THEN ' helpful'
  WHEN event_id % 37 = 0 THEN ' police' ELSE '' END ||
 CASE WHEN event_id % 5 = 0 THEN ' https://t.co/' || event_id ELSE '' END AS text,
 ts AS created_at, CAST(floor(value) AS BIGINT) AS retweet_count,
 CAST(floor(value * 3) AS BIGINT) AS like_count, 'user_' || user_id AS username,
 CAST(floor(abs(c_acctbal)) AS BIGINT) AS user_followers, {LOCATION} AS location,
 'twitter' AS platform, CASE WHEN event_id % 2 = 0 THEN 'spark' ELSE 'tech' END AS topic,
 event_type
FROM events
JOIN documents d ON d.doc_id = event_id % (SELECT count(*) FROM documents)
JOIN customer ON c_custkey = user_id JOIN nation ON n_nationkey = c_nationkey)"""

TAG_CELL = """CASE event_id % 4 WHEN 0 THEN '[''#Spark'', ''' || event_type || ''']'
 WHEN 1 THEN '#SparkSQL #' || event_type WHEN 2 THEN '[''#Tech'', #' || event_type END"""
TAG_CELL_TAGS = """CASE event_id % 4 WHEN 0 THEN ['Spark', event_type]
 WHEN 1 THEN ['SparkSQL', event_type] WHEN 2 THEN ['Tech', event_type]
 ELSE CAST([] AS VARCHAR[]) END"""


def tags(text: str) -> str:
    return f"regexp_extract_all({text}, {_text(K.HASHTAG_PATTERN)}, 1)"


def clean(text: str) -> str:
    step = f"replace(regexp_replace({text}, '{K.MENTION_PATTERN}', '', 'g'), '#', '')"
    step = f"regexp_replace({step}, {_text(K.RETWEET_PATTERN)}, '', 'g')"
    step = f"regexp_replace({step}, {_text(K.URL_PATTERN)}, '', 'g')"
    return f"coalesce(trim({step}, {SPACES}), '')"


def crisis(text: str, keywords=K.REFERENCE_KEYWORDS) -> str:
    return f"regexp_matches({text}, '(?i){'|'.join(keywords)}')"


def norm(location: str) -> str:
    place = f"trim(upper({location}), {SPACES})"
    return f"CASE WHEN {place} NOT IN ('', 'UNKNOWN', 'NONE', 'NULL') THEN {place} END"


CLEANED = f"{POSTS}, cleaned AS (SELECT *, {clean('text')} AS cleaned_text FROM posts)"

# Words of every cleaned post next to the word before them.
WORD = _text(K.WORD_PATTERN)
SCORED = f"""{CLEANED}, lexicon AS {LEXICON},
pairs AS (SELECT event_id, unnest(list_zip(w, list_prepend('', w))) AS p FROM
 (SELECT event_id, regexp_extract_all(lower(cleaned_text), {WORD}) AS w FROM cleaned)),
hits AS (SELECT event_id, polarity *
  CASE WHEN p[2] IN ('not', 'never', 'no') THEN -0.5 ELSE 1.0 END AS value
 FROM pairs JOIN lexicon ON p[1] = word),
means AS (SELECT event_id, avg(value) AS mean FROM hits GROUP BY event_id),
polar AS (SELECT c.*, round(coalesce(mean, 0), 6) AS polarity
 FROM cleaned c LEFT JOIN means USING (event_id)),
scored AS (SELECT *, CASE WHEN polarity > 0.1 THEN 'Positive' WHEN polarity < -0.1
 THEN 'Negative' ELSE 'Neutral' END AS sentiment FROM polar)"""

def _entries() -> str:
    """The fuller lexicon as the best entry of each phrase: polarity first, then intensity."""
    best: dict[str, tuple] = {}
    for word, polarity, intensity in [*((w, p, None) for w, p in K.LEXICON.items()), *MORE_POLARITIES]:
        if word is None or (polarity is None and intensity is None):
            continue
        rank = tuple(-99 if value is None else value for value in (polarity, intensity))
        if word not in best or rank > best[word][0]:
            best[word] = rank, (word, polarity, 1.0 if intensity is None else intensity)
    return _values([row for _, row in best.values()], "phrase, polarity, intensity")


def _state(spot: str, width: str, polarity: str, intensity: str, negates: str) -> str:
    """A hit together with the state of a fold before anything was found."""
    return (f"struct_pack(spot := CAST({spot} AS BIGINT), width := CAST({width} AS BIGINT), "
            f"polarity := {polarity}, intensity := {intensity}, negates := {negates}, "
            "total := 0.0::DOUBLE, n := 0::BIGINT, negated := -1::BIGINT, boost := 1.0::DOUBLE, "
            "boosted := -1::BIGINT, free := 0::BIGINT)")


# The hits of a post are folded in the order of its words.
FOLDED_POLARITY = f"""WITH {CLEANED}, entries AS {_entries()},
words AS (SELECT event_id, regexp_extract_all(lower(cleaned_text), {WORD}) AS w FROM cleaned),
places AS (SELECT * FROM (SELECT event_id, w, unnest(range(len(w))) AS spot FROM words)
 WHERE w[spot + 1] IN (SELECT split_part(phrase, ' ', 1) FROM entries
  UNION ALL SELECT unnest(['not', 'never', 'no']))),
known AS (SELECT event_id, spot, n AS width, polarity, intensity, false AS negates FROM
 (SELECT event_id, w, spot, unnest(range(1, 5)) AS n FROM places)
 JOIN entries ON phrase = array_to_string(w[spot + 1:spot + n], ' ') WHERE spot + n <= len(w)
 UNION ALL SELECT event_id, spot, 1, NULL, 1.0, true FROM places
 WHERE w[spot + 1] IN ('not', 'never', 'no')),
hits AS (SELECT * FROM known QUALIFY row_number() OVER (PARTITION BY event_id, spot
 ORDER BY width DESC, negates DESC) = 1),
listed_hits AS (SELECT event_id, list({_state('spot', 'width', 'CAST(polarity AS DOUBLE)',
 'CAST(intensity AS DOUBLE)', 'negates')} ORDER BY spot) AS found FROM hits GROUP BY event_id),
ends AS (SELECT event_id, list_reduce(list_prepend({_state('0', '0', 'NULL::DOUBLE', '1.0::DOUBLE',
 'false')}, found), lambda s, h: struct_pack(
 spot := h.spot, width := h.width, polarity := h.polarity, intensity := h.intensity,
 negates := h.negates,
 total := CASE WHEN h.spot < s.free OR h.negates OR h.polarity IS NULL THEN s.total
  ELSE s.total + greatest(-1.0::DOUBLE, least(1.0::DOUBLE, h.polarity
  * CASE WHEN s.boosted = h.spot THEN s.boost ELSE 1.0::DOUBLE END
  * CASE WHEN h.spot <= s.negated THEN {K.NEGATION_FACTOR}::DOUBLE ELSE 1.0::DOUBLE END)) END,
 n := CASE WHEN h.spot < s.free OR h.negates OR h.polarity IS NULL THEN s.n ELSE s.n + 1 END,
 negated := CASE WHEN h.spot < s.free THEN s.negated WHEN h.negates THEN h.spot + {K.NEGATION_REACH}
  WHEN h.polarity IS NOT NULL THEN -1::BIGINT
  WHEN h.spot <= s.negated THEN s.negated + h.width ELSE s.negated END,
 boost := CASE WHEN h.spot < s.free THEN s.boost
  WHEN h.negates OR h.polarity IS NOT NULL THEN 1.0::DOUBLE
  ELSE CASE WHEN s.boosted = h.spot THEN s.boost ELSE 1.0::DOUBLE END * h.intensity END,
 boosted := CASE WHEN h.spot < s.free THEN s.boosted
  WHEN h.negates OR h.polarity IS NOT NULL THEN -1::BIGINT ELSE h.spot + h.width END,
 free := CASE WHEN h.spot < s.free THEN s.free ELSE h.spot + h.width END)) AS last
 FROM listed_hits)
SELECT tweet_id, round(CASE WHEN last.n > 0 THEN last.total / last.n ELSE 0 END, 6) AS polarity
FROM cleaned LEFT JOIN ends USING (event_id)"""

REQUESTS = """requests AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'spark' ELSE 'tech' END
 AS topic_key, date_trunc('second', ts) AS second, true AS from_api FROM events)"""
MIXED = """requests AS (SELECT lower(CASE WHEN event_type = 'click' THEN 'Spark'
 WHEN event_type = 'view' THEN 'archive' WHEN event_id % 2 = 0 THEN 'spark' ELSE 'tech' END)
 AS topic_key, date_trunc('second', ts) AS second,
 event_type NOT IN ('view', 'signup') AS from_api FROM events)"""


def runs(requests: str) -> str:
    """Runs by following, from each start, the first opener an hour or more later."""
    return f"""{requests},
seconds AS (SELECT DISTINCT topic_key, second FROM requests),
openers AS (SELECT DISTINCT topic_key, second FROM requests r WHERE from_api OR second =
 (SELECT min(second) FROM requests f WHERE f.topic_key = r.topic_key)),
steps AS (SELECT topic_key, second, min(second) OVER (PARTITION BY topic_key ORDER BY second
 RANGE BETWEEN INTERVAL 1 HOUR FOLLOWING AND UNBOUNDED FOLLOWING) AS following FROM openers),
starts AS (SELECT topic_key, min(second) AS run_start FROM openers GROUP BY topic_key
 UNION ALL SELECT s.topic_key, n.following FROM starts s JOIN steps n
 ON n.topic_key = s.topic_key AND n.second = s.run_start WHERE n.following IS NOT NULL),
runs AS (SELECT q.topic_key, q.second AS requested_at, s.run_start
 FROM seconds q ASOF JOIN starts s ON q.topic_key = s.topic_key AND q.second >= s.run_start)"""


RUNS = runs(REQUESTS)
PLACED = """placed AS (SELECT p.*, r.run_start FROM {posts} p JOIN runs r
 ON r.topic_key = p.topic AND r.requested_at = date_trunc('second', p.created_at))"""



def _dealt_runs(parts: int = 4) -> str:
    """Runs of events that come in parts: a request older than the run that is open when its
    part comes counts into that run."""
    steps = []
    for k in range(parts):
        asked = f"SELECT topic_key, second FROM moved{k}"
        since, before = "second", ""
        if k:
            asked += f" UNION SELECT topic_key, run_start FROM open{k - 1}"
            since, before = "greatest(second, run_start)", f"LEFT JOIN open{k - 1} USING (topic_key)"
        steps.append(f"""moved{k} AS (SELECT event_id, topic_key, {since} AS second FROM (
 SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'spark' ELSE 'tech' END AS topic_key,
 date_trunc('second', ts) AS second FROM events WHERE event_id % {parts} = {k}) {before}),
asked{k} AS (SELECT DISTINCT * FROM ({asked})),
steps{k} AS (SELECT topic_key, second, min(second) OVER (PARTITION BY topic_key ORDER BY second
 RANGE BETWEEN INTERVAL 1 HOUR FOLLOWING AND UNBOUNDED FOLLOWING) AS following FROM asked{k}),
starts{k} AS (SELECT topic_key, min(second) AS run_start FROM asked{k} GROUP BY topic_key
 UNION ALL SELECT s.topic_key, n.following FROM starts{k} s JOIN steps{k} n
 ON n.topic_key = s.topic_key AND n.second = s.run_start WHERE n.following IS NOT NULL),
open{k} AS (SELECT topic_key, max(run_start) AS run_start FROM starts{k} GROUP BY topic_key),
runs{k} AS (SELECT m.event_id, s.run_start FROM moved{k} m ASOF JOIN starts{k} s
 ON m.topic_key = s.topic_key AND m.second >= s.run_start)""")
    every = " UNION ALL ".join(f"SELECT * FROM runs{k}" for k in range(parts))
    return ", ".join([*steps, f"dealt AS ({every})"])


DEALT = f"{_dealt_runs()}, placed AS (SELECT p.*, run_start FROM scored p JOIN dealt USING (event_id))"

LOCATED = f"""{POSTS}, counted AS (SELECT topic, location, count(*) AS count FROM
 (SELECT topic, {norm('location')} AS location FROM posts) WHERE location IS NOT NULL
 GROUP BY ALL),
gazetteer AS (SELECT unnest([upper(n_name), 'NATION ' || n_nationkey]) AS location,
 n_name AS country, CAST((n_nationkey * 7) % 160 - 80 AS DOUBLE) AS lat,
 CAST((n_nationkey * 13) % 340 - 170 AS DOUBLE) AS lon FROM nation)"""

# Free-text locations: the longest known ending, else spellings one edit away, by brute force.
SPELLED = """CASE event_id % 7 WHEN 0 THEN 'Old Town, ' || location WHEN 1 THEN 'Port ' || location
 WHEN 2 THEN replace(lower(location), 'nation', 'nattion')
 WHEN 3 THEN 'Harbour/' || location || 'x' ELSE location END"""
PLACES = f"""{POSTS}, counted AS (SELECT topic, location, count(*) AS count FROM
 (SELECT topic, {norm(f'({SPELLED})')} AS location FROM posts) WHERE location IS NOT NULL
 GROUP BY ALL),
gazetteer AS (SELECT unnest([upper(n_name), 'NATION ' || n_nationkey]) AS alias,
 n_name AS country, CAST((n_nationkey * 7) % 160 - 80 AS DOUBLE) AS lat,
 CAST((n_nationkey * 13) % 340 - 170 AS DOUBLE) AS lon FROM nation),
found AS (SELECT DISTINCT location, list_filter(
 string_split_regex(location, {_text(K.PLACE_SEPARATORS)}), lambda w: w <> '') AS w FROM counted),
endings AS (SELECT location, n, array_to_string(w[len(w) - n + 1:], ' ') AS ending
 FROM found, range(1, 3) AS r(n) WHERE n <= len(w)),
named AS (SELECT location, arg_max((country, lat, lon), n) AS place FROM endings
 JOIN gazetteer ON ending = alias GROUP BY location),
near AS (SELECT location, arg_min((country, lat, lon), (-n, alias, country)) AS place FROM endings
 JOIN gazetteer ON levenshtein(ending, alias) = 1 WHERE length(ending) >= {K.TYPING_ERROR_LENGTH}
 AND length(alias) >= {K.TYPING_ERROR_LENGTH}
 AND location NOT IN (SELECT location FROM named) GROUP BY location),
places AS (SELECT location, place, 'name' AS resolved_by FROM named
 UNION ALL SELECT location, place, 'typing error' FROM near),
resolved AS (SELECT location, place[1] AS country, place[2] AS lat, place[3] AS lon, resolved_by
 FROM found LEFT JOIN places USING (location))"""

CSV = f"""{POSTS}, cells AS (SELECT event_id, event_type, text, created_at, username,
 CAST(retweet_count AS VARCHAR) AS retweets, CAST(like_count AS VARCHAR) AS likes,
 nullif(location, '') AS location, {TAG_CELL} AS tags, {TAG_CELL_TAGS} AS tag_list,
 strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS time FROM posts),
lines AS (SELECT n_nationkey % 3 = 0 AS too_long, 'Hello, ' || n_name AS text,
 'u' || n_nationkey AS username, '"Hello, ' || n_name || '",u' || n_nationkey || ',EXTRA,' ||
 n_nationkey AS raw FROM nation)"""

API_COLUMNS = """topic, created_at AS requested_at, CASE WHEN event_id % 23 <> 0 THEN tweet_id
 ELSE left(sha256(text), 32) END AS tweet_id, text, created_at, retweet_count,
 like_count, CASE WHEN event_id % 19 = 0 THEN 'unknown' ELSE username END AS username,
 CASE WHEN event_id % 19 = 0 THEN 0 ELSE user_followers END AS user_followers,
 CAST(NULL AS VARCHAR) AS location, platform"""

TAG_ROWS = f"""tag_rows AS (SELECT *, lower(tag) AS hashtag FROM
 (SELECT *, unnest({tags('text')}) AS tag FROM posts) WHERE contains(lower(tag), topic))"""
TAG_COUNTS = f"{POSTS}, {TAG_ROWS}, tag_counts AS (SELECT topic, hashtag, count(*) AS count FROM tag_rows GROUP BY ALL)"

WORDS = f"""{CLEANED}, stopwords AS {STOPWORDS},
listed AS (SELECT topic, list_filter(list_transform(regexp_extract_all(lower(cleaned_text),
 {WORD}), lambda w: CASE WHEN ends_with(w, '''s') THEN left(w, length(w) - 2) ELSE w END),
 lambda w: NOT regexp_full_match(w, '[0-9]*')) AS w FROM cleaned)"""

def _log_likelihood(hits: str, tries: str, share: str) -> str:
    return (f"({hits} * ln(greatest({share}, 1e-10))"
            f" + ({tries} - {hits}) * ln(greatest(1 - {share}, 1e-10)))")


RATIO = " ".join((
    "2 * (", _log_likelihood("count", "na", "(count / na)"), "+",
    _log_likelihood("(nb - count)", "(total - na)", "((nb - count) / (total - na))"), "-",
    _log_likelihood("count", "na", "(nb / total)"), "-",
    _log_likelihood("(nb - count)", "(total - na)", "(nb / total)"), ")"))
COLLOCATIONS = f"""{WORDS},
stopped AS (SELECT topic, unnest(w) AS word FROM listed),
singles AS (SELECT topic, word, count(*) AS n FROM stopped
 WHERE word NOT IN (SELECT word FROM stopwords) GROUP BY ALL),
totals AS (SELECT topic, CAST(sum(n) AS DOUBLE) AS total FROM singles GROUP BY topic),
together AS (SELECT topic, p[1] AS a, p[2] AS b, count(*) AS count FROM
 (SELECT topic, unnest(list_zip(w[:-2], w[2:])) AS p FROM listed WHERE len(w) > 1)
 WHERE p[1] NOT IN (SELECT word FROM stopwords) AND p[2] NOT IN (SELECT word FROM stopwords)
 GROUP BY ALL),
measured AS (SELECT t.*, x.n AS na, y.n AS nb, total FROM together t
 JOIN singles x ON x.topic = t.topic AND x.word = a
 JOIN singles y ON y.topic = t.topic AND y.word = b JOIN totals ON totals.topic = t.topic),
collocations AS (SELECT topic, a, b, count, {RATIO} AS score FROM measured
 WHERE total > na AND total > nb AND {RATIO} > {K.COLLOCATION_THRESHOLD})"""

NAME = _text(K.NAME_PATTERN)
ENTITIES_FOUND = f"""{CLEANED}, listed_entities AS {ENTITY_DICT},
entity_dict AS (SELECT DISTINCT entity, label, array_to_string(e, ' ') AS phrase, e[1] AS head,
 len(e) AS n FROM (SELECT entity, label, regexp_extract_all(entity, {NAME}) AS e
 FROM listed_entities) WHERE entity IS NOT NULL AND label IS NOT NULL AND len(e) > 0),
names AS (SELECT topic, tweet_id, regexp_extract_all(cleaned_text, {NAME}) AS w FROM cleaned),
placed AS (SELECT * FROM (SELECT topic, tweet_id, w, unnest(range(len(w))) AS position FROM names)
 WHERE w[position + 1] IN (SELECT head FROM entity_dict)),
matches AS (SELECT p.topic, p.tweet_id, p.position, d.n, d.entity, d.label FROM placed p
 JOIN entity_dict d ON d.head = p.w[p.position + 1]
 AND d.phrase = array_to_string(p.w[p.position + 1:p.position + d.n], ' ')),
entities AS (SELECT topic, tweet_id, CAST(position AS INTEGER) AS position, entity, label
 FROM matches m WHERE NOT EXISTS (SELECT 1 FROM matches o WHERE o.tweet_id = m.tweet_id
  AND o.n > m.n AND o.position <= m.position AND o.position + o.n >= m.position + m.n))"""


def ranked(source: str, order: str, k: int, columns: str = "*", by: str = "topic") -> str:
    return (
        f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY {by} "
        f"ORDER BY {order}) AS rn FROM {source}) WHERE rn <= {k}"
    )


def weighted(source: str, name: str, more: str = "") -> str:
    best = ranked(source, f"count DESC, {name}", K.TOP_WORDS, f"topic, {name}, count{more}")
    return (
        f"SELECT *, round(count / max(count) OVER (PARTITION BY topic), 6) AS weight FROM ({best})"
    )


def score(crisis_posts: str, total: str) -> str:
    return f"least(100.0, CAST({crisis_posts} AS DOUBLE) / {total} * 1000)"


def level(value: str, thresholds=K.ALERT_THRESHOLDS) -> str:
    cases = " ".join(f"WHEN {value} > {bound} THEN '{name}'" for bound, name in thresholds)
    return f"CASE {cases} ELSE 'Normal' END"


def crisis_view(groups: str, keywords=K.REFERENCE_KEYWORDS, thresholds=K.ALERT_THRESHOLDS) -> str:
    return f"""SELECT *, {level('crisis_score', thresholds)} AS alert_level FROM
 (SELECT *, {score('crisis_posts', 'total_posts')} AS crisis_score FROM
 (SELECT {groups}, count(*) FILTER ({crisis('cleaned_text', keywords)}) AS crisis_posts,
 count(*) AS total_posts FROM cleaned GROUP BY ALL))"""


HOURLY = (
    f"WITH {POSTS} SELECT topic, date_trunc('hour', created_at) AS hour, count(*) AS count "
    "FROM posts GROUP BY ALL"
)
SENTIMENT_METRICS = (
    "SELECT {by}, 'sentiment_' || sentiment AS metric, CAST(count(*) AS VARCHAR) AS value "
    "FROM {source} GROUP BY {by}, sentiment"
)
WHOLE = """CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)"""
NEWEST = "(SELECT topic_key, max(run_start) AS run_start FROM runs GROUP BY topic_key)"

ORACLE: dict[str, str] = {
    # sources
    "src_csv_posts": f"""WITH {CSV} SELECT text AS "Tweet_Text", time AS "Timestamp",
 username AS "Author", retweets AS "Retweets", CASE WHEN event_id % 2 = 0 THEN likes END AS "Likes",
 CASE WHEN event_id % 2 = 1 THEN likes ELSE '0' END AS "Favorites", location AS "Country",
 tags AS "Hashtags", event_type, NULL AS "Text", NULL AS "DateTime", NULL AS "User",
 NULL AS retweet_count, NULL AS "Place", NULL AS "Tweet", NULL AS reason, NULL AS rejected
 FROM cells WHERE event_id % 3 = 0
 UNION ALL BY NAME SELECT text AS "Text", time AS "DateTime", username AS "User",
 retweets AS retweet_count, location AS "Place", tags AS "Hashtags", event_type FROM cells
 WHERE event_id % 3 = 1
 UNION ALL BY NAME SELECT text AS "Tweet", event_type FROM cells WHERE event_id % 3 = 2
 UNION ALL BY NAME SELECT text AS "Text", username AS "User" FROM lines WHERE NOT too_long
 UNION ALL BY NAME SELECT 'more cells than headers' AS reason, raw AS rejected FROM lines
 WHERE too_long""",
    "src_csv_alias": f"""WITH {CSV} SELECT text, time AS created_at, username,
 retweets AS retweet_count, likes AS like_count,
 location, tags AS hashtags, event_type FROM cells WHERE event_id % 3 = 0
 UNION ALL BY NAME SELECT text, time AS created_at, username, retweets AS retweet_count, location,
 tags AS hashtags, event_type FROM cells WHERE event_id % 3 = 1
 UNION ALL BY NAME SELECT text, event_type FROM cells WHERE event_id % 3 = 2
 UNION ALL BY NAME SELECT text, username FROM lines WHERE NOT too_long""",
    "src_csv_defaults": f"""WITH {CSV}, read AS (
 SELECT text, created_at, CAST(retweets AS BIGINT) AS retweet_count,
  CAST(likes AS BIGINT) AS like_count, username, location, tag_list FROM cells WHERE event_id % 3 = 0
 UNION ALL BY NAME SELECT text, created_at, CAST(retweets AS BIGINT) AS retweet_count, username,
  location, tag_list FROM cells WHERE event_id % 3 = 1
 UNION ALL BY NAME SELECT text FROM cells WHERE event_id % 3 = 2
 UNION ALL BY NAME SELECT text, username FROM lines WHERE NOT too_long)
 SELECT 'spark' AS topic, {NOW} AS requested_at, text, coalesce(created_at, {NOW}) AS created_at,
 coalesce(retweet_count, 0) AS retweet_count, coalesce(like_count, 0) AS like_count,
 coalesce(username, 'unknown') AS username, 0::BIGINT AS user_followers, location,
 'twitter' AS platform, 'csv' AS source,
 array_to_string(list_concat(coalesce(tag_list, []), {tags('text')}), ',') AS tags FROM read""",
    "src_api_batch": f"WITH {POSTS} SELECT {API_COLUMNS} FROM posts",
    "src_api_filter": f"""WITH {POSTS}, tagged AS MATERIALIZED (SELECT *,
 {tags('lower(text)')} AS tags FROM posts), wanted AS (SELECT * FROM tagged WHERE
 NOT starts_with(text, 'RT @') AND list_contains(tags, topic))
 {ranked('wanted', 'created_at DESC, tweet_id', K.API_RESULTS_DEFAULT,
         'topic, tweet_id, text, created_at')}""",
    "src_api_stream": f"WITH {POSTS} SELECT {API_COLUMNS} FROM posts",
    "src_store_tables": f"""WITH RECURSIVE {SCORED}, {DEALT}
 SELECT topic, run_start, tweet_id, cleaned_text, sentiment, created_at, retweet_count, username,
 location, CAST(hour(created_at) AS INTEGER) AS hour FROM placed
 WHERE (topic, run_start) IN (SELECT topic, max(run_start) FROM placed GROUP BY topic)""",
    # sinks
    "snk_init_tables": f"""WITH RECURSIVE {SCORED}, {RUNS}, {PLACED.format(posts='scored')},
 {TAG_ROWS.replace('FROM posts', 'FROM placed')}
 SELECT 'searches' AS table_name, (SELECT count(*) FROM starts) AS n_rows
 UNION ALL SELECT 'tweets', (SELECT count(*) FROM posts)
 UNION ALL SELECT 'hashtags', (SELECT count(DISTINCT (topic, run_start, hashtag)) FROM tag_rows)
 UNION ALL SELECT 'analytics', (SELECT count(DISTINCT (topic, run_start, sentiment)) FROM placed)
""",
    "snk_append_run": f"""WITH RECURSIVE {SCORED}, {RUNS}, {PLACED.format(posts='scored')},
 {TAG_ROWS.replace('FROM posts', 'FROM placed')}
 SELECT *, 'api' AS source FROM (
 {SENTIMENT_METRICS.format(by='topic, run_start', source='placed')} UNION ALL
 SELECT topic, run_start, 'hashtag_' || hashtag, CAST(count(*) AS VARCHAR)
 FROM tag_rows GROUP BY topic, run_start, hashtag)""",
    "snk_export_csv_json": f"""SELECT *, 'csv' AS format FROM ({HOURLY}) UNION ALL
 SELECT *, 'json' FROM ({HOURLY})""",
    "snk_report_json": f"""WITH {SCORED}, {TAG_ROWS},
 tag_counts AS (SELECT topic, hashtag, count(*) AS count FROM tag_rows GROUP BY ALL),
 best AS ({ranked('tag_counts', 'count DESC, hashtag', K.TOP_HASHTAGS)}),
 listed AS (SELECT topic, list({{'hashtag': hashtag, 'count': count}}
  ORDER BY count DESC, hashtag) AS top_hashtags FROM best GROUP BY topic),
 figures AS (SELECT topic, count(*) AS total_posts,
  count(*) FILTER (sentiment = 'Positive') AS positive_posts,
  count(*) FILTER (sentiment = 'Negative') AS negative_posts,
  count(*) FILTER (sentiment = 'Neutral') AS neutral_posts,
  round_even(avg(retweet_count), 1) AS avg_retweets,
  count(*) FILTER ({crisis('cleaned_text')}) AS crisis_posts FROM scored GROUP BY topic),
 leveled AS (SELECT *, {score('crisis_posts', 'total_posts')} AS crisis_score FROM figures)
 SELECT topic, CAST(to_json({{'topic': topic, 'total_posts': total_posts,
  'positive_posts': positive_posts, 'negative_posts': negative_posts,
  'neutral_posts': neutral_posts, 'avg_retweets': avg_retweets, 'crisis_posts': crisis_posts,
  'crisis_score': round(crisis_score, 4), 'alert_level': {level('crisis_score')},
  'top_hashtags': top_hashtags}}) AS VARCHAR) AS report
 FROM leveled LEFT JOIN listed USING (topic)""",
    # filters and projections
    "flt_topic_rows": f"""SELECT tweet_id, hashtags FROM (SELECT CAST(event_id AS VARCHAR)
 AS tweet_id, {TAG_CELL} AS hashtags FROM events)
 WHERE regexp_matches(lower(hashtags), 'spark(sql)?')""",
    "flt_topic_tags": f"""WITH {POSTS} SELECT topic, tweet_id, array_to_string(list_filter(
 {tags('text')}, lambda t: contains(lower(t), topic)), ',') AS tags FROM posts""",
    "flt_crisis": f"""WITH {CLEANED} SELECT topic, tweet_id,
 CAST(length(cleaned_text) AS INTEGER) AS n_chars FROM cleaned WHERE {crisis('cleaned_text')}""",
    "flt_metric_prefix": f"""WITH {SCORED} SELECT topic, sentiment AS metric,
 CAST(count(*) AS DOUBLE) AS value FROM scored GROUP BY topic, sentiment""",
    "flt_run_scope": f"""WITH RECURSIVE {POSTS}, {RUNS}, {PLACED.format(posts='posts')}
 SELECT topic, tweet_id, run_start FROM placed
 WHERE topic = 'tech' AND (topic, run_start) IN {NEWEST}""",
    "flt_topic_eq_ci": """SELECT CASE WHEN event_type = 'click' THEN 'SPARK' ELSE 'spark' END
 AS topic, CAST(event_id AS VARCHAR) AS tweet_id FROM events WHERE event_id % 2 = 0""",
    "prj_engagement": f"""WITH {SCORED} SELECT topic, tweet_id, text, sentiment, retweet_count,
 like_count, CASE WHEN retweet_count > 0 THEN round(log10(retweet_count), 6) END AS log_retweets,
 CASE WHEN like_count > 0 THEN round(log10(like_count), 6) END AS log_likes,
 CAST(retweet_count + like_count AS DOUBLE) AS engagement_index FROM scored""",
    "prj_crisis_sample": f"""WITH {SCORED}, kept AS (SELECT * FROM scored
 WHERE {crisis('cleaned_text')}) {ranked('kept', 'created_at, tweet_id', K.CRISIS_SAMPLE,
                                        'topic, tweet_id, text, sentiment')}""",
    # joins
    "jn_post_author": """SELECT CAST(event_id AS VARCHAR) AS tweet_id, author_id,
 coalesce(c_name, 'unknown') AS username,
 coalesce(CAST(floor(abs(c_acctbal)) AS BIGINT), 0) AS user_followers FROM
 (SELECT event_id, CASE WHEN event_id % 19 = 0 THEN 'gone' ELSE CAST(user_id AS VARCHAR) END
  AS author_id FROM events) LEFT JOIN customer ON CAST(c_custkey AS VARCHAR) = author_id""",
    "jn_latest_run": f"""WITH RECURSIVE {POSTS}, {RUNS}, {PLACED.format(posts='posts')}
 SELECT topic, run_start, tweet_id, username, retweet_count FROM placed
 WHERE (topic, run_start) IN {NEWEST}""",
    "jn_geocode": f"""WITH {PLACES} SELECT c.*, country, lat, lon FROM counted c
 JOIN resolved USING (location) WHERE lat IS NOT NULL AND lon IS NOT NULL""",
    "jn_geo_markers": f"""WITH {LOCATED}, best AS ({ranked(
        'counted', 'count DESC, location', K.TOP_LOCATIONS, 'topic, location, count')})
 SELECT * FROM best JOIN gazetteer USING (location)""",
    # aggregates
    "agg_hashtag_counts": f"WITH {TAG_COUNTS} SELECT * FROM tag_counts",
    "agg_hashtag_counts_all": f"""WITH {POSTS} SELECT hashtag, count(*) AS count FROM
 (SELECT unnest({tags('text')}) AS hashtag FROM posts) GROUP BY hashtag""",
    "agg_sentiment_counts": f"""WITH {SCORED}
 {SENTIMENT_METRICS.format(by='topic', source='scored')}""",
    "agg_sentiment_share": f"""WITH {SCORED} SELECT topic, sentiment,
 CAST(count(*) AS DOUBLE) AS posts,
 round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY topic), 6) AS percent
 FROM scored GROUP BY topic, sentiment""",
    "agg_hourly_volume": HOURLY,
    "agg_top_users": f"""WITH {POSTS}, users AS (SELECT topic, username, count(*) AS tweet_count,
 CAST(sum(retweet_count) AS BIGINT) AS retweet_count FROM posts GROUP BY topic, username)
 {ranked('users', 'tweet_count DESC, username', K.TOP_USERS,
         'topic, username, tweet_count, retweet_count')}""",
    "agg_influencers": f"""WITH {POSTS}, users AS (SELECT topic, username,
 max(user_followers) AS user_followers FROM posts GROUP BY topic, username)
 {ranked('users', 'user_followers DESC, username', K.TOP_INFLUENCERS,
         'topic, username, user_followers')}""",
    "agg_entity_counts": f"""WITH {ENTITIES_FOUND}, counted AS (SELECT topic, entity, label,
 count(*) AS count FROM entities GROUP BY ALL) {ranked(
        'counted', 'count DESC, entity, label', K.TOP_ENTITIES, 'topic, entity, label, count')}""",
    "agg_location_counts": f"WITH {LOCATED} SELECT topic, location, count FROM counted",
    "agg_geo_center": f"""WITH {LOCATED} SELECT topic, round(avg(lat), 6) AS center_lat,
 round(avg(lon), 6) AS center_lon FROM counted JOIN gazetteer USING (location) GROUP BY topic""",
    "agg_kpi_row": f"""WITH {SCORED} SELECT topic, count(*) AS total_posts,
 count(*) FILTER (sentiment = 'Positive') AS positive_posts,
 round_even(avg(retweet_count), 1) AS avg_retweets FROM scored GROUP BY topic""",
    "agg_crisis_score": f"WITH {CLEANED} {crisis_view('topic')}",
    "agg_crisis_score_fixed": f"""WITH {CLEANED} {crisis_view(
        'event_type', K.FIXED_KEYWORDS, ((90, 'HIGH'), (40, 'MODERATED')))}""",
    "agg_word_freq": f"""WITH {WORDS}, counted AS (SELECT topic, word, count(*) AS count FROM
 (SELECT topic, unnest(w) AS word FROM listed) WHERE word NOT IN (SELECT word FROM stopwords)
 GROUP BY topic, word) {weighted('counted', 'word')}""",
    "agg_word_bigrams": f"""WITH {COLLOCATIONS}, counted AS (SELECT topic, a || ' ' || b AS bigram,
 count, round(score, 3) AS score FROM collocations) {weighted('counted', 'bigram', ', score')}""",
    "agg_word_cloud": f"""WITH {COLLOCATIONS}, counted AS (
 SELECT topic, word, CAST(n - coalesce(used, 0) AS BIGINT) AS count FROM singles LEFT JOIN (
  SELECT topic, word, sum(count) AS used FROM (SELECT topic, unnest([a, b]) AS word, count
   FROM collocations) GROUP BY ALL) USING (topic, word) WHERE n > coalesce(used, 0)
 UNION ALL SELECT topic, a || ' ' || b, count FROM collocations) {weighted('counted', 'word')}""",
    # first row per group
    "win_latest_run": f"""WITH RECURSIVE {RUNS} SELECT topic_key AS topic,
 max(run_start) AS timestamp, 'api' AS source FROM starts GROUP BY topic_key""",
    "win_dedupe_user": f"""WITH {POSTS} {ranked(
        'posts', 'user_followers DESC, created_at, tweet_id', 1,
        'topic, username, user_followers, tweet_id, created_at, location', 'topic, username')}""",
    "win_topic_runs": f"WITH RECURSIVE {RUNS} SELECT * FROM runs",
    "win_topic_runs_ci": f"WITH RECURSIVE {runs(MIXED)} SELECT * FROM runs",
    # top-k
    "top_hashtags": f"""WITH {TAG_COUNTS} {ranked(
        'tag_counts', 'count DESC, hashtag', K.TOP_HASHTAGS, 'topic, hashtag, count')}""",
    "top_topics_recent": f"""SELECT 'user_' || user_id AS topic, max(ts) AS last_search FROM events
 GROUP BY user_id ORDER BY last_search DESC, topic LIMIT {K.TOP_TOPICS}""",
    "top_locations": f"""WITH {LOCATED} {ranked(
        'counted', 'count DESC, location', K.TOP_LOCATIONS, 'topic, location, count')}""",
    # set operations
    "set_append_posts": f"""WITH {POSTS}, batch AS (SELECT topic, tweet_id, username, created_at,
 retweet_count FROM posts) SELECT * FROM batch UNION ALL SELECT * FROM batch""",
    "set_merge_tag_counts": f"""WITH {TAG_COUNTS} SELECT topic, hashtag, 2 * count AS count
 FROM tag_counts""",
    "set_distinct_locations": f"WITH {LOCATED} SELECT DISTINCT location FROM counted",
    # functions
    "fn_clean_text": f"WITH {CLEANED} SELECT tweet_id, cleaned_text FROM cleaned",
    "fn_extract_hashtags": f"""WITH {POSTS} SELECT tweet_id,
 array_to_string({tags('text')}, ',') AS tags, len({tags('text')}) AS n_tags FROM posts""",
    "fn_parse_tag_list": f"""WITH {POSTS} SELECT tweet_id, array_to_string(list_concat(
 {TAG_CELL_TAGS}, {tags('text')}), ',') AS tags FROM posts""",
    "fn_sentiment_label": f"WITH {SCORED} SELECT tweet_id, sentiment FROM scored",
    "fn_to_count": f"""SELECT event_id, CASE event_id % 8
 WHEN 0 THEN CAST(floor(value) AS BIGINT) WHEN 1 THEN -CAST(floor(value) AS BIGINT)
 WHEN 4 THEN CAST(floor(value) AS BIGINT) * 100 ELSE 0 END AS count FROM events""",
    "fn_to_timestamp": f"""SELECT event_id, CASE WHEN event_id % 8 < 6
 THEN date_trunc('second', ts) ELSE {NOW} END AS created_at FROM events""",
    "fn_date_parts": """SELECT event_id, CAST(year(ts) AS INTEGER) AS year,
 CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day,
 CAST(hour(ts) AS INTEGER) AS hour FROM events""",
    "fn_floor_hour": "SELECT event_id, date_trunc('hour', ts) AS hour FROM events",
    "fn_norm_location": f"WITH {POSTS} SELECT tweet_id, {norm('location')} AS location FROM posts",
    "fn_post_id": """SELECT lang, count(*) AS n_texts, count(DISTINCT text) AS n_ids
 FROM documents GROUP BY lang""",
    "fn_alert_level": f"""SELECT event_id, {level('floor(value) / 4')} AS alert_level,
 {level('floor(value) / 4', ((50, 'LOUD'), (10, 'AUDIBLE')))} AS own_level FROM events""",
    "fn_engagement_index": f"""WITH {POSTS} SELECT tweet_id,
 retweet_count * 2.0::DOUBLE + like_count * 0.5::DOUBLE AS engagement_index FROM posts""",
    "fn_fill_str": f"""WITH {POSTS} SELECT tweet_id, coalesce(location, 'unknown') AS location
 FROM posts""",
    # text analytics
    "txt_polarity": FOLDED_POLARITY,
    "txt_polarity_words": f"WITH {SCORED} SELECT tweet_id, polarity, true AS agree FROM scored",
    "txt_entities": f"WITH {ENTITIES_FOUND} SELECT * FROM entities",
    # Every rank of every topic has a word of the texts, as far as they have so many words.
    "txt_topics_lda_facts": f"""WITH {CLEANED}, tokens AS (SELECT unnest(regexp_extract_all(
 lower(cleaned_text), {_text(K.LDA_WORD_PATTERN)})) AS word FROM cleaned), known AS (
 SELECT count(DISTINCT word) AS n FROM tokens WHERE length(word) BETWEEN
 {K.LDA_WORD_LENGTHS[0]} AND {K.LDA_WORD_LENGTHS[1]} AND NOT starts_with(word, '_'))
 SELECT CAST(t.topic AS INTEGER) AS topic_id, CAST(r.rank AS INTEGER) AS rank, true AS occurs,
 true AS is_distinct, true AS weight_in_range, true AS falling
 FROM known, range({K.LDA_TOPICS}) AS t(topic), range(1, {K.LDA_WORDS} + 1) AS r(rank)
 WHERE r.rank <= n""",
    "txt_topic_coherence": f"""WITH {CLEANED}, tokens AS (SELECT event_id, topic,
 list_distinct(list_filter(regexp_extract_all(lower(cleaned_text), {_text(K.LDA_WORD_PATTERN)}),
 lambda w: length(w) BETWEEN {K.LDA_WORD_LENGTHS[0]} AND {K.LDA_WORD_LENGTHS[1]}
 AND NOT starts_with(w, '_'))) AS w FROM cleaned),
inside AS (SELECT event_id, topic, unnest(w) AS word FROM tokens),
counted AS (SELECT topic, word, count(*) AS n FROM inside GROUP BY ALL),
best AS ({ranked('counted', 'n DESC, word', 10, 'topic, word')}),
wanted AS (SELECT x.topic, x.word AS a, y.word AS b FROM best x JOIN best y USING (topic)
 WHERE x.word < y.word),
posted AS (SELECT event_id, word FROM inside WHERE word IN (SELECT word FROM best)),
single AS (SELECT word, count(*) AS n FROM posted GROUP BY word),
met AS (SELECT x.word AS a, y.word AS b, count(*) AS n FROM posted x JOIN posted y USING (event_id)
 WHERE x.word < y.word GROUP BY ALL),
measured AS (SELECT topic, CASE WHEN m.n IS NULL THEN -1.0 WHEN m.n = total THEN 1.0
 ELSE ln(m.n / total * total * total / (p.n * q.n)) / -ln(m.n / total) END AS npmi
 FROM wanted LEFT JOIN met m USING (a, b) LEFT JOIN single p ON p.word = a
 LEFT JOIN single q ON q.word = b, (SELECT CAST(count(*) AS DOUBLE) AS total FROM cleaned))
SELECT topic, count(*) AS n_pairs, round(avg(npmi), 6) AS coherence FROM measured GROUP BY topic""",
    "txt_geo_resolve": f"WITH {PLACES} SELECT * FROM resolved",
    # streams
    "st_hourly_volume": HOURLY,
    "st_hashtag_counts": f"WITH {TAG_COUNTS} SELECT * FROM tag_counts",
    "st_sentiment_counts": f"""WITH {SCORED} SELECT topic, sentiment, count(*) AS count
 FROM scored GROUP BY topic, sentiment""",
    "st_crisis_score": f"""WITH {CLEANED} {crisis_view(
        "topic, date_trunc('hour', created_at) AS hour")}""",
    "st_dedupe_posts": f"""WITH {POSTS} SELECT topic, tweet_id, username, created_at,
 retweet_count + 3 AS retweet_count, created_at + INTERVAL 2 HOUR AS requested_at FROM posts""",
    "st_topic_runs": f"WITH RECURSIVE {RUNS} SELECT * FROM runs",
    "st_sink_append": f"""WITH RECURSIVE {SCORED}, {DEALT}
 SELECT topic, run_start, sentiment, count(*) AS n_posts,
 CAST(sum(retweet_count) AS BIGINT) AS retweets FROM placed GROUP BY ALL""",
    # data checks
    "dq_required_columns": f"""WITH {POSTS} SELECT topic, count(text) AS n_texts FROM posts
 GROUP BY topic""",
    "dq_sentiment_domain": f"""WITH {SCORED}, spoiled AS (SELECT topic,
 CASE WHEN event_type = 'error' THEN 'Mixed' ELSE sentiment END AS sentiment FROM scored)
 SELECT topic, sentiment, sentiment <> 'Mixed' AS is_valid, count(*) AS n_posts
 FROM spoiled GROUP BY ALL""",
}

ORACLE["dq_skip_unusable"] = " UNION ALL ".join(
    f"SELECT '{name}' AS view_name, posts, CASE posts WHEN 'all' THEN n ELSE 0 END AS n_rows"
    f" FROM (SELECT count(*) AS n FROM ({ORACLE[name]})), (VALUES ('all'), ('none')) AS v(posts)"
    for name in SIZED_VIEWS
)
