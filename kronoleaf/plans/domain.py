"""The activity tables (media, messages, events, links, people, places) over the driver's tables.

Each table is one SELECT in the SQL that Spark and DuckDB share, so a query and its
SQL read the same rows. Names in braces are the driver's tables. Every row of
the driver's table that plays a role is mapped; kinds and states are chosen by
its values, texts and coordinates are fixed functions of its keys.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame

_AT = "substr(cast(ts as string), 1, 19)"
_DAY = "concat('2024-01-', lpad(cast(o_orderkey % 30 + 1 as string), 2, '0'))"
_CASE_DAY = "concat('2024-01-', lpad(cast(c_custkey % 29 + 1 as string), 2, '0'))"
_CASE_LIST = "CASE c_custkey % 8 WHEN 1 THEN 'kind' WHEN 3 THEN 'call_status' WHEN 4 THEN 'day' WHEN 5 THEN 'source' WHEN 6 THEN 'media' ELSE 'evidence' END"

TABLES: dict[str, str] = {
    "media": f"""SELECT concat('media_', event_id) AS id, concat('IMG_', event_id, '.jpg') AS file_name, concat('h', event_id % 1900) AS file_hash, 'image' AS media_type,
        CASE WHEN event_type = 'view' THEN {_AT} END AS captured_at, {_AT} AS fallback_captured_at,
        CASE WHEN value >= 30 THEN cast(35 as double) + cast(user_id % 13 as double) / 1000 END AS gps_lat,
        CASE WHEN value >= 30 THEN cast(139 as double) + cast(user_id % 7 as double) / 1000 END AS gps_lon,
        CASE WHEN event_type = 'view' THEN 'Cam A' ELSE 'Cam B' END AS camera_model, concat('user_', user_id) AS owner
        FROM {{events}} WHERE event_type IN ('view', 'purchase')""",
    "messages": f"""SELECT concat('line_', event_id) AS id, concat('chat_', user_id % 9) AS chat_id, {_AT} AS sent_at, concat('user_', user_id) AS sender,
        CASE event_id % 16 WHEN 0 THEN '新宿駅に着いた' WHEN 1 THEN 'ランチ食べた おいしかった' WHEN 2 THEN '☎ 通話時間 10:38' WHEN 3 THEN '☎ 通話時間 1:26:14' WHEN 4 THEN '☎ 不在着信' WHEN 5 THEN '☎ 応答がありませんでした'
        WHEN 6 THEN '着いたら連絡する かも' WHEN 7 THEN 'ラーメン行こう' WHEN 8 THEN 'カフェで待ってる' WHEN 9 THEN '☎ キャンセル' WHEN 10 THEN '予約の候補を探す' WHEN 11 THEN '仕事の話' WHEN 12 THEN '映画を見に行く？' WHEN 13 THEN '渋谷で買い物' WHEN 14 THEN '' END AS text,
        CASE event_type WHEN 'signup' THEN 'image' WHEN 'error' THEN 'text' ELSE 'text' END AS message_type
        FROM {{events}} WHERE event_type IN ('click', 'signup', 'error')""",
    "life_events": f"""SELECT concat('event_', o_orderkey) AS id, {_DAY} AS date, concat(lpad(cast(o_custkey % 24 as string), 2, '0'), ':00:00') AS start_time,
        CASE WHEN o_orderstatus = 'P' THEN NULL ELSE concat(lpad(cast(o_custkey % 24 as string), 2, '0'), ':45:00') END AS end_time,
        CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN '食事・カフェの可能性' WHEN '2' THEN '移動・待ち合わせの可能性' WHEN '3' THEN '通話・連絡' WHEN '4' THEN 'LINEのやりとり' ELSE 'Private note' END AS title,
        CASE WHEN o_orderstatus = 'F' THEN concat('summary of ', o_custkey) END AS summary,
        CASE o_custkey % 5 WHEN 0 THEN '新宿' WHEN 1 THEN '渋谷' WHEN 2 THEN '' WHEN 3 THEN '東京駅' END AS location_name,
        CASE WHEN o_orderstatus <> 'P' THEN cast(35 as double) + cast(o_custkey % 11 as double) / 1000 END AS gps_lat,
        CASE WHEN o_orderstatus <> 'P' THEN cast(139 as double) + cast(o_custkey % 5 as double) / 1000 END AS gps_lon,
        CASE WHEN o_orderstatus = 'O' AND o_custkey % 10 = 0 THEN NULL ELSE cast(o_custkey % 101 as double) / 100 END AS confidence,
        CASE WHEN o_orderstatus = 'P' THEN 'manual' ELSE 'generated' END AS source, 'rule_based_daily_v2' AS generation_method,
        CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'F' THEN 1 ELSE 0 END AS is_user_edited FROM {{orders}}""",
    "evidence": """SELECT event_id, evidence_type, concat(CASE WHEN evidence_type IN ('line', 'event') THEN 'line_' ELSE 'media_' END, l_partkey) AS evidence_id, weight FROM
        (SELECT concat('event_', l_orderkey) AS event_id, l_partkey, l_discount AS weight,
        CASE WHEN l_returnflag = 'R' THEN 'photo' WHEN l_returnflag = 'A' THEN 'line' WHEN l_linestatus = 'F' THEN 'ocr' ELSE 'vlm' END AS evidence_type FROM {lineitem})""",
    "overrides": """SELECT concat('event_', o_orderkey) AS event_id, CASE o_orderstatus WHEN 'F' THEN 'edited title' WHEN 'O' THEN '' END AS title_override, CASE WHEN o_orderstatus = 'P' THEN 'edited summary' END AS summary_override,
        CASE WHEN o_orderstatus = 'F' THEN '横浜' END AS location_name_override, CASE WHEN o_orderstatus = 'P' THEN '["trip","food"]' WHEN o_orderstatus = 'F' THEN 'not json' END AS tags_json,
        CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS is_verified, CASE WHEN o_totalprice < 50000 THEN 1 ELSE 0 END AS is_hidden, CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS is_pinned
        FROM {orders} WHERE o_orderpriority IN ('1-URGENT', '4-NOT SPECIFIED')""",
    "ocr": """SELECT concat('media_', doc_id) AS media_id, text AS ocr_text, substr(text, 1, 200) AS ocr_text_redacted, CASE WHEN lang = 'fr' THEN 'fake_ocr' ELSE 'engine_a' END AS ocr_engine,
        CASE lang WHEN 'en' THEN 'jpn+eng' WHEN 'de' THEN 'deu' ELSE 'jpn' END AS ocr_languages, CASE lang WHEN 'es' THEN 'failed' WHEN 'fr' THEN 'engine_unavailable' ELSE 'success' END AS status,
        concat('2024-01-', lpad(cast(doc_id % 30 + 1 as string), 2, '0')) AS analyzed_at FROM {documents}""",
    "vlm": """SELECT concat('media_', doc_id) AS media_id, concat(source, ' ', lang, ' picture of ramen') AS caption, CASE WHEN lang <> 'de' THEN concat(lang, ' meal') END AS short_caption,
        concat('["', lang, '","', source, '","indoor"]') AS scene_tags_json, CASE WHEN lang = 'en' THEN '["ramen_possible"]' ELSE '[]' END AS food_cues_json, '["walk"]' AS activity_tags_json,
        CASE WHEN lang = 'es' THEN 'station, shop' END AS location_cues_json, CASE WHEN lang = 'de' THEN '["forbidden_terms_found"]' END AS safety_flags_json,
        concat('["', source, '_object"]') AS object_tags_json, CASE lang WHEN 'fr' THEN '["exit sign"]' END AS text_cues_json,
        CASE WHEN source IN ('src1', 'src2') THEN 'fake_vlm' ELSE 'model_a' END AS vlm_engine, CASE WHEN source = 'src3' THEN 'failed' ELSE 'success' END AS status,
        cast(doc_id % 3 as int) AS people_count, cast(doc_id % 101 as double) / 100 AS confidence, concat('2024-01-', lpad(cast(doc_id % 30 + 1 as string), 2, '0')) AS analyzed_at FROM {documents}""",
    "vlm_overrides": """SELECT concat('media_', doc_id) AS media_id, CASE WHEN quality = 0 THEN 'corrected caption' END AS caption_override, CASE WHEN toxic = 1 THEN '' END AS short_caption_override,
        CASE WHEN doc_id % 5 = 0 THEN '["corrected","outdoor"]' WHEN toxic = 1 THEN '' END AS scene_tags_override_json, CASE WHEN doc_id % 7 = 0 THEN '["table"]' END AS object_tags_override_json, CASE WHEN doc_id % 11 = 0 THEN '["cycling"]' END AS activity_tags_override_json,
        CASE WHEN quality = 0 THEN '["noodles"]' END AS food_cues_override_json, CASE WHEN doc_id % 3 = 0 THEN '' WHEN quality = 0 THEN '["harbour"]' END AS location_cues_override_json,
        quality AS is_verified, toxic AS is_hidden, CASE WHEN quality = 0 AND toxic = 1 THEN 1 ELSE 0 END AS is_wrong, CASE WHEN toxic = 1 THEN 0 ELSE 1 END AS is_searchable,
        CASE WHEN quality = 0 THEN 0 ELSE 1 END AS is_event_usable, CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'accepted' ELSE 'needs_review' END AS review_status FROM {labels}""",
    "persons": """SELECT concat('person_', c_custkey) AS id, c_name AS display_name, CASE WHEN c_mktsegment <> 'BUILDING' THEN concat('P', c_custkey) END AS public_name, concat('["ali', c_custkey, '","ali', c_custkey % 50, '"]') AS aliases_json,
        CASE WHEN c_acctbal < 0 THEN 'hidden' WHEN c_mktsegment = 'MACHINERY' THEN 'private' ELSE 'public_alias' END AS privacy_level, CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS is_hidden,
        CASE WHEN c_acctbal > 9000 THEN 1 ELSE 0 END AS is_deleted, CASE WHEN c_mktsegment = 'FURNITURE' THEN 0 ELSE 1 END AS searchable, c_custkey AS created_order FROM {customer}""",
    "aliases": """SELECT concat('person_', c_custkey) AS person_id, concat('nick', c_nationkey, '_', c_mktsegment) AS alias, 'manual' AS source FROM {customer}""",
    "speaker_links": """SELECT DISTINCT concat('chat_', user_id % 9) AS chat_id, concat('user_', user_id) AS speaker_name, concat('person_', user_id) AS person_id, CASE WHEN user_id % 4 = 0 THEN 0 ELSE 1 END AS is_verified,
        cast(user_id % 10 as double) / 10 AS confidence FROM {events}""",
    "media_people": """SELECT DISTINCT concat('media_', l_partkey) AS media_id, concat('person_', l_suppkey) AS person_id, concat('face_', l_orderkey % 4000) AS face_id, CASE WHEN l_returnflag = 'N' THEN 'manual' ELSE 'face_cluster' END AS source,
        cast(85 as double) / 100 AS confidence, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS is_verified, CASE WHEN l_tax > cast(7 as double) / 100 THEN 1 ELSE 0 END AS is_hidden FROM {lineitem}""",
    "event_people": """SELECT concat('event_', o_orderkey) AS event_id, concat('person_', o_custkey) AS person_id, CASE WHEN o_orderpriority < '3' THEN 'face' ELSE 'chat' END AS source, cast(70 as double) / 100 AS confidence,
        CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS is_verified, CASE WHEN o_totalprice < 20000 THEN 1 ELSE 0 END AS is_hidden FROM {orders}""",
    "places": """SELECT concat('place_', n_nationkey) AS id, n_name AS display_name, CASE WHEN n_regionkey <> 2 THEN concat('Area ', n_nationkey) END AS public_name, concat('["', lower(n_name), '","spot', n_nationkey % 7, '"]') AS aliases_json,
        CASE n_regionkey WHEN 0 THEN 'home' WHEN 1 THEN 'station' WHEN 2 THEN 'work' ELSE 'restaurant' END AS category, concat('pc_', n_nationkey) AS cluster_id, CASE WHEN n_regionkey = 0 THEN 'sensitive' ELSE 'normal' END AS privacy_level,
        CASE WHEN n_regionkey = 4 THEN 1 ELSE 0 END AS hidden, CASE WHEN n_regionkey = 3 THEN 0 ELSE 1 END AS searchable, cast(35 as double) + cast(n_nationkey as double) / 2000 AS lat, cast(139 as double) + cast(n_nationkey as double) / 4000 AS lon,
        cast(150 + n_nationkey * 10 as double) AS radius_m FROM {nation}""",
    "event_places": """SELECT concat('event_', o_orderkey) AS event_id, concat('place_', c_nationkey) AS place_id, cast(75 as double) / 100 AS confidence, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS manual_verified
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE o_orderpriority <> '5-LOW'""",
    "media_places": """SELECT DISTINCT concat('media_', l_partkey) AS media_id, concat('place_', s_nationkey) AS place_id, cast(80 as double) / 100 AS confidence FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey WHERE l_returnflag = 'R'""",
    "faces": """SELECT DISTINCT concat('face_', l_orderkey % 4000) AS id, concat('media_', (l_orderkey % 4000) % 2000) AS media_id, CASE WHEN l_orderkey % 4000 % 9 = 0 THEN 'rejected' WHEN l_orderkey % 4000 % 5 = 0 THEN 'pending' ELSE 'confirmed' END AS review_status, 'success' AS status FROM {lineitem}""",
    "face_members": """SELECT DISTINCT concat('fc_', (l_orderkey % 4000) % 120) AS cluster_id, concat('face_', l_orderkey % 4000) AS face_id, cast((l_orderkey % 4000) % 10 as double) / 100 AS distance_to_centroid FROM {lineitem}""",
    "face_clusters": """SELECT DISTINCT concat('fc_', (l_orderkey % 4000) % 120) AS id, CASE WHEN (l_orderkey % 4000) % 120 % 11 = 0 THEN 'rejected' ELSE 'reviewed' END AS status FROM {lineitem}""",
    "person_clusters": """SELECT DISTINCT concat('person_', l_orderkey % 4000 % 120 % 50) AS person_id, concat('fc_', (l_orderkey % 4000) % 120) AS cluster_id, CASE WHEN (l_orderkey % 4000) % 120 % 3 = 0 THEN 0 ELSE 1 END AS is_verified FROM {lineitem}""",
    "media_vectors": """SELECT concat('media_', vec_id % 400) AS media_id, CASE WHEN vec_id < 400 THEN 'image' ELSE 'text' END AS embedding_type, embedding, CASE label WHEN 0 THEN 'failed' ELSE 'success' END AS status, CASE label WHEN 1 THEN 'fake_model' ELSE 'model_a' END AS embedding_model, vec_id FROM {embeddings}""",
    "image_queries": """SELECT vec_id AS query_id, embedding, CASE label % 4 WHEN 0 THEN 'ramen' WHEN 1 THEN 'meal' WHEN 2 THEN 'src5' ELSE 'indoor' END AS term_1, CASE label % 3 WHEN 0 THEN '新宿' WHEN 1 THEN 'カフェ' ELSE 'tion' END AS term_2 FROM {embeddings} WHERE vec_id % 20 = 0""",
    "eval_cases": f"""SELECT concat('case_', c_custkey) AS case_id, CASE c_custkey % 8 WHEN 0 THEN 'date_qa' WHEN 1 THEN 'keyword_search' WHEN 2 THEN 'time_range_summary' WHEN 3 THEN 'call_search' WHEN 4 THEN 'place_qa' WHEN 5 THEN 'person_qa' WHEN 6 THEN 'image_search' ELSE 'voice_search' END AS type,
        {_CASE_DAY} AS date_from, concat('2024-01-', lpad(cast(c_custkey % 29 + 1 + CASE WHEN c_custkey % 8 = 0 THEN 0 ELSE c_nationkey % 3 END as string), 2, '0')) AS date_to,
        CASE c_custkey % 7 WHEN 0 THEN 'ランチ' WHEN 1 THEN ' カフェ ' WHEN 2 THEN '新宿' WHEN 3 THEN 'src5' WHEN 4 THEN 'Ramen' WHEN 5 THEN 'en picture' ELSE '渋谷' END AS query,
        concat('place_', c_nationkey + c_custkey % 2) AS place_id, concat('person_', c_custkey) AS person_id FROM {{customer}}""",
    "eval_expectations": f"""SELECT concat('case_', c_custkey) AS case_id, 'at_least' AS rule, CASE c_custkey % 8 WHEN 1 THEN 'score' WHEN 3 THEN 'calls' WHEN 6 THEN 'photos' ELSE 'events' END AS subject, cast(NULL as string) AS wanted, cast(c_custkey % 40 as double) AS bound FROM {{customer}}
        UNION ALL SELECT concat('case_', c_custkey), 'at_most', CASE c_custkey % 8 WHEN 3 THEN 'longest' WHEN 6 THEN 'photos' ELSE 'confidence' END, cast(NULL as string), CASE c_custkey % 8 WHEN 3 THEN cast(638 + c_nationkey * 400 as double) WHEN 6 THEN cast(c_custkey as double) ELSE cast(90 + c_custkey % 11 as double) / 100 END FROM {{customer}}
        UNION ALL SELECT concat('case_', c_custkey), 'includes', CASE c_custkey % 8 WHEN 3 THEN 'call_status' WHEN 5 THEN 'source' WHEN 6 THEN 'media' ELSE 'day' END, CASE c_custkey % 8 WHEN 3 THEN 'missed' WHEN 5 THEN 'face' WHEN 6 THEN concat('media_', c_custkey % 303) ELSE {_CASE_DAY} END, cast(c_nationkey + 4 as double) FROM {{customer}}
        UNION ALL SELECT concat('case_', c_custkey), 'excludes', CASE c_custkey % 8 WHEN 6 THEN 'media' WHEN 3 THEN 'call_status' ELSE 'day' END, CASE c_custkey % 8 WHEN 6 THEN concat('media_', c_custkey % 101) WHEN 3 THEN 'unknown' ELSE '2024-01-09' END, CASE c_custkey % 8 WHEN 3 THEN NULL ELSE cast(3 as double) END FROM {{customer}}
        UNION ALL SELECT concat('case_', c_custkey), 'any_of', {_CASE_LIST}, CASE c_custkey % 8 WHEN 3 THEN 'canceled' WHEN 4 THEN '2024-01-30' WHEN 6 THEN 'media_7' ELSE 'line' END, cast(NULL as double) FROM {{customer}}
        UNION ALL SELECT concat('case_', c_custkey), 'any_of', {_CASE_LIST}, CASE c_custkey % 8 WHEN 1 THEN 'event' WHEN 3 THEN 'completed' WHEN 4 THEN {_CASE_DAY} WHEN 5 THEN 'face' WHEN 6 THEN concat('media_', c_custkey % 503) ELSE 'ocr' END, cast(NULL as double) FROM {{customer}}
        UNION ALL SELECT concat('case_', c_custkey), 'mentions', CASE c_custkey % 8 WHEN 0 THEN 'title' WHEN 2 THEN 'title' ELSE {_CASE_LIST} END, CASE c_custkey % 8 WHEN 0 THEN '通話' WHEN 2 THEN 'カフェ' WHEN 1 THEN 'e' WHEN 4 THEN '-01-' WHEN 6 THEN '_1' ELSE 'c' END, cast(NULL as double) FROM {{customer}}
        UNION ALL SELECT concat('case_', c_custkey), 'lacks', 'title', CASE WHEN c_nationkey % 2 = 0 THEN '確実に' ELSE 'edited' END, cast(NULL as double) FROM {{customer}}""",
    "date_ranges": f"""SELECT DISTINCT concat(date_from, '/', date_to) AS range_id, date_from, date_to FROM (SELECT {_CASE_DAY} AS date_from, concat('2024-01-', lpad(cast(c_custkey % 29 + 1 + c_nationkey % 3 as string), 2, '0')) AS date_to FROM {{customer}}
        UNION ALL SELECT '2024-01-01', '2024-01-31' FROM {{customer}})""",
    "job_items": """SELECT concat('job_', l_orderkey) AS job_id, concat('media_', l_partkey) AS item_id, CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'success' ELSE CASE l_linestatus WHEN 'O' THEN 'skipped' ELSE 'pending' END END AS status FROM {lineitem}""",
}
_DRIVER = re.compile(r"\{(\w+)\}")


def table(load: Callable[[str], DataFrame], name: str, repeated: bool = False) -> DataFrame:
    """An activity table from the driver's tables that `load` gives; with `repeated`, rows that a DISTINCT would drop stay, for callers that tell rows apart themselves."""
    used = {n: load(n) for n in sorted(set(_DRIVER.findall(TABLES[name])))}
    spark = next(iter(used.values())).sparkSession
    return spark.sql(TABLES[name].replace("SELECT DISTINCT", "SELECT", 1) if repeated else TABLES[name], **used)


def with_tables(sql: str) -> str:
    """SQL for DuckDB with the activity tables that it names put before it."""
    used = [n for n in TABLES if re.search(rf"\b{n}\b", sql)]
    if not used:
        return sql
    heads = ", ".join(f"{n} AS ({_DRIVER.sub(r'\1', TABLES[n])})" for n in used)
    return f"WITH {heads}, {sql[5:]}" if sql.lstrip().startswith("WITH ") else f"WITH {heads} {sql}"
