"""DuckDB statements that check the queries of data_queries."""

_KEY = "nullif(CASE WHEN ends_with({a}, '.0') THEN left({a}, length({a}) - 2) ELSE {a} END, '')"
MESSAGE_AUTHOR = _KEY.format(a="trim(author, ' ')")
OWNER = _KEY.format(a="trim(regexp_extract(id, '^(.*)_[^_]*$', 1, 's'), ' ')")

_LATEST = "latest AS (SELECT store, id, operation FROM op_log QUALIFY row_number() OVER (PARTITION BY store, id ORDER BY arrived_at DESC) = 1)"
_MARKS = "marks AS (SELECT index_name, store, max(read_to) FILTER (WHERE status = 'succeeded') AS mark FROM index_runs GROUP BY ALL)"
_HELD = """held AS (SELECT m.index_name, o.store, o.id, o.operation FROM op_log o JOIN marks m ON o.store = m.store AND o.arrived_at <= m.mark
  QUALIFY row_number() OVER (PARTITION BY m.index_name, o.store, o.id ORDER BY o.arrived_at DESC) = 1)"""
_P1 = f"WITH {_LATEST}, {_MARKS}, {_HELD}, every AS (SELECT m.index_name, l.store, l.id, l.operation FROM latest l JOIN marks m ON l.store = m.store)"

P1_FOUND = f"""{_P1}
SELECT e.index_name, e.store, e.id AS op_id FROM every e LEFT JOIN held h ON h.index_name = e.index_name AND h.store = e.store AND h.id = e.id
WHERE h.id IS NULL OR h.operation IS DISTINCT FROM e.operation"""

P1_CATCH_UP = f"""{_P1}
SELECT e.index_name, e.store, e.id AS op_id, CASE WHEN h.id IS NULL THEN 'added' WHEN h.operation IS DISTINCT FROM e.operation THEN 'changed' ELSE 'held' END AS how
FROM every e LEFT JOIN held h ON h.index_name = e.index_name AND h.store = e.store AND h.id = e.id"""

_P2 = f"""WITH u AS (SELECT id, min(arrived_at) AS came FROM users GROUP BY id), m AS (SELECT id, min(arrived_at) AS came FROM messages GROUP BY id),
i AS (SELECT id, min(arrived_at) AS came FROM messages_by_user GROUP BY id),
refs AS (
  SELECT DISTINCT 'messages' AS ref_table, r.id, m.came, {MESSAGE_AUTHOR} AS k, u.id AS parent, u.came AS parent_came
  FROM messages r JOIN m ON m.id = r.id LEFT JOIN u ON u.id = {MESSAGE_AUTHOR}
  UNION ALL
  SELECT DISTINCT 'messages_by_user', r.id, i.came, nullif(r.to_id, ''), m.id, m.came FROM messages_by_user r JOIN i ON i.id = r.id LEFT JOIN m ON m.id = r.to_id),
direct AS (SELECT ref_table, id, came, CASE WHEN parent IS NULL THEN 'absent' WHEN parent_came > came THEN 'late' END AS state FROM refs
  WHERE k IS NOT NULL AND (parent IS NULL OR parent_came > came))"""

P2_FOUND = f"{_P2} SELECT DISTINCT ref_table, id AS record_id, strftime(came, '%Y-%m') AS ref_month, state FROM direct"

P2_REPORT = f"""{_P2}, inherited AS (
  SELECT r.ref_table, r.id, r.came, min(d.state) AS state FROM refs r JOIN direct d ON d.ref_table = 'messages' AND r.ref_table = 'messages_by_user' AND r.k = d.id
  WHERE r.id NOT IN (SELECT id FROM direct WHERE ref_table = 'messages_by_user') GROUP BY ALL)
SELECT ref_table, strftime(came, '%Y-%m') AS ref_month, state, kind, count(*) AS n FROM (
  SELECT DISTINCT ref_table, id, came, state, 'direct' AS kind FROM direct UNION ALL SELECT ref_table, id, came, state, 'inherited' FROM inherited) GROUP BY ALL"""

P3_FOUND = f"""SELECT 'messages' AS table_name, k AS author_key FROM (SELECT {MESSAGE_AUTHOR} AS k FROM messages) WHERE k IS NOT NULL GROUP BY k
  HAVING count(*) * 100 >= (SELECT count(*) FROM messages)
UNION ALL SELECT 'messages_by_user', k FROM (SELECT {OWNER} AS k FROM messages_by_user) WHERE k IS NOT NULL GROUP BY k
  HAVING count(*) * 100 >= (SELECT count(*) FROM messages_by_user)"""

P3_AUTHOR_STATS = f"""WITH m AS (SELECT {MESSAGE_AUTHOR} AS k, written_at, reactions FROM messages),
r AS (SELECT k, written_at, row_number() OVER (PARTITION BY k ORDER BY written_at) AS i, count(*) OVER (PARTITION BY k) AS n FROM m WHERE k IS NOT NULL AND written_at IS NOT NULL),
e AS (SELECT k, count(DISTINCT e) AS n FROM (SELECT k, unnest(reactions) AS e FROM m) GROUP BY k)
SELECT k AS author_key, s.n AS n_messages, first_written, last_written, q.q1 AS written_q1, q.q2 AS written_median, q.q3 AS written_q3, coalesce(e.n, 0) AS n_reactions
FROM (SELECT k, count(*) AS n, min(written_at) AS first_written, max(written_at) AS last_written FROM m WHERE k IS NOT NULL GROUP BY k) s
LEFT JOIN (SELECT k, max(written_at) FILTER (WHERE i = greatest(1, ceil(0.25 * n))) AS q1, max(written_at) FILTER (WHERE i = greatest(1, ceil(0.5 * n))) AS q2,
  max(written_at) FILTER (WHERE i = greatest(1, ceil(0.75 * n))) AS q3 FROM r GROUP BY k) q USING (k) LEFT JOIN e USING (k)"""

P3_AUTHOR_REACTIONS = f"SELECT DISTINCT author_key, reaction FROM (SELECT {MESSAGE_AUTHOR} AS author_key, unnest(reactions) AS reaction FROM messages) WHERE author_key IS NOT NULL AND reaction IS NOT NULL"

_EVENTS = f"""{_LATEST}, events AS (SELECT store, id, operation.op_type = 'put' AS put, operation.obj.id AS object_id, operation.obj.name AS name,
  operation.obj.author AS author, operation.obj.text AS text, operation.obj.reactions AS reactions FROM latest
  WHERE operation.op_type IN ('put', 'delete') AND operation.obj.id IS NOT NULL)"""
_LAST = "last AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY store, object_id ORDER BY id DESC) = 1)"

P4_FOUND = f"WITH {_EVENTS}, {_LAST} SELECT store, object_id, id AS op_id FROM last WHERE put"

P4_CURRENT_STATE = f"""WITH {_EVENTS}, {_LAST}, base AS (
  SELECT 'users' AS store, id AS object_id, name, NULL AS author, NULL AS text, CAST(NULL AS VARCHAR[]) AS reactions FROM users QUALIFY row_number() OVER (PARTITION BY id ORDER BY arrived_at DESC) = 1
  UNION ALL SELECT 'messages', id, NULL, author, text, reactions FROM messages QUALIFY row_number() OVER (PARTITION BY id ORDER BY arrived_at DESC) = 1)
SELECT store, object_id, op_id, name, author, text, CASE WHEN reactions IS NOT NULL THEN CAST(to_json(reactions) AS VARCHAR) END AS reactions FROM (
  SELECT store, object_id, id AS op_id, name, author, text, reactions FROM last WHERE put
  UNION ALL SELECT store, object_id, '', name, author, text, reactions FROM base b WHERE NOT EXISTS (SELECT 1 FROM last l WHERE l.store = b.store AND l.object_id = b.object_id))"""

_P5 = f"""WITH {_EVENTS},
steps AS (SELECT *, lag(put) OVER w AS was, lag(struct_pack(n := name, a := author, t := text, r := reactions)) OVER w AS had FROM events WINDOW w AS (PARTITION BY store, object_id ORDER BY id)),
bounds AS (SELECT * FROM steps WHERE CASE WHEN put THEN coalesce(NOT was, true) OR had IS DISTINCT FROM struct_pack(n := name, a := author, t := text, r := reactions) ELSE coalesce(was, false) END),
ops AS (SELECT *, lead(id) OVER (PARTITION BY store, object_id ORDER BY id) AS valid_to FROM bounds),
snaps AS (SELECT taken_on, id, name FROM user_snapshots QUALIFY row_number() OVER (PARTITION BY taken_on, id ORDER BY loaded_at DESC) = 1),
dates AS (SELECT taken_on, row_number() OVER (ORDER BY taken_on) AS i FROM (SELECT DISTINCT taken_on FROM user_snapshots)),
seen AS (SELECT s.*, i, lag(i) OVER w AS last_i, lag(name) OVER w AS last_name FROM snaps s JOIN dates USING (taken_on) WINDOW w AS (PARTITION BY id ORDER BY taken_on)),
runs AS (SELECT *, sum(CASE WHEN last_i = i - 1 AND name IS NOT DISTINCT FROM last_name THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY taken_on) AS run FROM seen),
snap_versions AS (SELECT id, run, any_value(name) AS name, min(taken_on) AS first_on, max(i) AS last_i FROM runs GROUP BY id, run),
versions AS (
  SELECT store AS origin, object_id, name, author, text, CASE WHEN reactions IS NOT NULL THEN CAST(to_json(reactions) AS VARCHAR) END AS reactions, id AS valid_from, valid_to FROM ops WHERE put
  UNION ALL SELECT 'user_snapshots', id, name, NULL, NULL, NULL, strftime(first_on, '%Y-%m-%d'), strftime(d.taken_on, '%Y-%m-%d') FROM snap_versions v LEFT JOIN dates d ON d.i = v.last_i + 1)"""

P5_FOUND = f"{_P5} SELECT origin, object_id, valid_from, coalesce(valid_to, '') AS valid_to FROM versions"
P5_VERSIONS = f"{_P5} SELECT * FROM versions"

SQL = {
    "p1_found": P1_FOUND, "p1_catch_up": P1_CATCH_UP, "p2_found": P2_FOUND, "p2_report": P2_REPORT, "p3_found": P3_FOUND, "p3_author_stats": P3_AUTHOR_STATS,
    "p3_author_reactions": P3_AUTHOR_REACTIONS, "p4_found": P4_FOUND, "p4_current_state": P4_CURRENT_STATE, "p5_found": P5_FOUND, "p5_versions": P5_VERSIONS,
}
