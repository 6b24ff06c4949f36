"""Reference SQL of every job, for an engine that reads the same tables.

Where a job decodes bytes, the SQL does not decode them again: it states the expected
value from the integers the bytes were made of.
"""

from __future__ import annotations

from fieldstream.plans import dimensions as dim
from fieldstream.plans.layouts import (
    EVENT_IDS,
    LAYOUTS,
    TYPE_IDS,
    all_decoded_columns,
    decoded_columns,
    event_csv_columns,
)

from . import formulas as f
from . import inputs
from . import jobs as j

TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
ORACLES: dict[str, str] = {}

E = """e AS (SELECT event_id, epoch_us(ts) AS t_us, user_id, event_type, props,
 user_id % 8 AS session_id, user_id % 256 AS device_id,
 cast(round(value * 100) AS BIGINT) AS c FROM events)"""


def oracle(name: str, body: str, *ctes: str, recursive: bool = False) -> None:
    """Register SQL; the result is cast to the job's declared shape."""
    columns = [p.rsplit(" ", 1) for p in j.SHAPES[name].split(", ")]
    casts = ", ".join(f'CAST("{c}" AS {TYPES[kind]}) AS "{c}"' for c, kind in columns)
    head = "WITH " + ("RECURSIVE " if recursive else "") + ", ".join([E, *ctes])
    ORACLES[name] = f"{head} SELECT {casts} FROM ({body}) AS result"


def oracles() -> dict[str, str]:
    return dict(ORACLES)


def hx(expr: str, size: int) -> str:
    """``size`` bytes of an integer as lower-case hex."""
    mask = (1 << (8 * size)) - 1
    return f"lpad(lower(to_hex((({expr})::BIGINT & {mask})::BIGINT)), {2 * size}, '0')"


def byte_list(h: str) -> str:
    digit = "(instr('0123456789abcdef', substr({h}, {at}, 1)) - 1)"
    high = digit.format(h=h, at="2 * p + 1")
    low = digit.format(h=h, at="2 * p + 2")
    return f"list_transform(range(0, length({h}) // 2), lambda p: ({high} * 16 + {low})::BIGINT)"


def crc(h: str) -> str:
    """CRC-16 of a hex text, poly 0x1021, seed 0xFFFF, in closed form per byte."""
    first = "xor(a >> 8, b) & 255"
    x = f"xor({first}, ({first}) >> 4)"
    step = f"xor(xor(xor(a << 8, ({x}) << 12), ({x}) << 5), {x}) & 65535"
    return f"list_reduce({byte_list(h)}, lambda a, b: ({step})::BIGINT, 65535::BIGINT)"


def py_round(x: str, digits: int) -> str:
    s = f"1e{digits}"
    split = f"({x} * 134217729e0)"
    high = f"({split} - ({split} - {x}))"
    p = f"({x} * {s})"
    error = f"(({high} * {s} - {p}) + ({x} - {high}) * {s})"
    d = f"((({p}) - floor({p})) - 0.5e0 + {error})"
    return (f"(CASE WHEN {x} IS NULL THEN NULL WHEN {d} > 0 THEN floor({p}) + 1 "
            f"WHEN {d} < 0 THEN floor({p}) ELSE round_even({p}, 0) END / {s})")


def joined(parts: list[str], sep: str = ";") -> str:
    """Non-NULL parts, sorted, as one text."""
    return (f"array_to_string(list_sort(list_filter([{', '.join(parts)}], "
            f"lambda x: x IS NOT NULL)), '{sep}')")


# ------------------------------------------------------------------ shared inputs

R = "r AS (SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in f.READING.items()) + " FROM e)"

T = ("""t0 AS (SELECT * FROM (SELECT event_id, t_us, session_id, device_id, c,
 """ + f.SOURCE_SQL + """ AS device_type FROM e) AS s),
t AS (SELECT *, upper(device_type) AS msg_type,
 (row_number() OVER (PARTITION BY session_id, device_type ORDER BY t_us, event_id) - 1) % 65536
 AS seq, """ + f.EVENT_TYPE_SQL + """ AS event_type, """ + f.PACKET_TS + """ AS packet_ts,
 """ + f.RECEIVED + """ AS received_us, """
     + ", ".join(f"{v} AS {k}" for k, v in f.typed_columns().items()) + " FROM t0)")


def _raw_wire(t: str, field) -> str:
    if field.name not in f.TYPED[t.lower()]:
        return "NULL::BIGINT"
    return (f"CASE WHEN msg_type = '{t}' THEN "
            f"round_even({field.name} * {field.scale}e0, 0)::BIGINT END")


WIRED = "wired AS (SELECT *, " + ", ".join(
    f"{_raw_wire(t, x)} AS w_{t}_{x.name}" for t, fields in LAYOUTS.items() for x in fields
) + " FROM t)"


def _clamped(t, x):
    wire = f"w_{t}_{x.name}"
    return f"(CASE WHEN {wire} IS NOT NULL THEN greatest({x.low}, least({x.high}, {wire})) END)"


def _case(build, column="msg_type"):
    return f"CASE {column} " + " ".join(
        f"WHEN '{t}' THEN {build(t, fields)}" for t, fields in LAYOUTS.items()) + " END"


MASK = _case(lambda t, fields: " + ".join(
    f"CASE WHEN w_{t}_{x.name} IS NOT NULL THEN {x.bit} ELSE 0 END" for x in fields))
CLAMPED = _case(lambda t, fields: "array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN w_{t}_{x.name} < {x.low} OR w_{t}_{x.name} > {x.high} THEN '{x.name}' END"
    for x in fields) + "], lambda x: x IS NOT NULL), ',')")
PAYLOAD = _case(lambda t, fields: " || ".join(
    f"coalesce({hx(_clamped(t, x), x.size)}, '')" for x in fields))
ERROR = "CASE WHEN msg_type = 'GPS' THEN 'wrong device_type' WHEN msg_type = 'MPPT' AND mppt_index IS NULL THEN 'missing mppt_index' END"
TYPE_CODE = "CASE msg_type " + " ".join(f"WHEN '{t}' THEN {n}" for t, n in TYPE_IDS.items()) + " END"
EVENT_CODE = "CASE event_type " + " ".join(
    f"WHEN '{t}' THEN {n}" for t, n in EVENT_IDS.items()) + " END"
MASKED = f"""masked AS (SELECT *, {MASK} AS field_mask, {CLAMPED} AS clamped,
 {ERROR} AS encode_error FROM wired)"""
HEXED = f"""bodies AS (SELECT *, '03' || {hx(TYPE_CODE, 1)} || {hx(EVENT_CODE, 1)}
 || {hx('device_id', 1)} || {hx('seq', 2)} || {hx('packet_ts', 4)} || {hx('field_mask', 2)}
 || {PAYLOAD} AS body FROM masked),
hexed AS (SELECT *, CASE WHEN encode_error IS NULL THEN body || {hx(crc('body'), 2)} END
 AS packet_hex FROM bodies)"""


def _value(name: str) -> str:
    """Decoded value of a column over all types that have it."""
    parts = []
    for t, fields in LAYOUTS.items():
        for x in fields:
            if x.name == name:
                number = f"{_clamped(t, x)}::DOUBLE"
                if x.divisor != 1:
                    number += f" / {x.divisor}e0"
                parts.append(f"WHEN w_{t}_{name} IS NOT NULL THEN {number}")
    return "CASE " + " ".join(parts) + " END"


WIRE_NAMES = [c for c in all_decoded_columns() if c != "motor_temp_f"]
DECODED = ("d0 AS (SELECT event_id, t_us, received_us, session_id, 3 AS version, msg_type, "
           "event_type, device_id, seq, packet_ts, field_mask, "
           + ", ".join(f"{_value(c)} AS {c}" for c in WIRE_NAMES)
           + " FROM masked WHERE encode_error IS NULL), "
           "d AS (SELECT *, " + py_round("(motor_temp_c * 9e0 / 5e0 + 32e0)", 2)
           + " AS motor_temp_f FROM d0)")
PACKET_CTES = (T, WIRED, MASKED, DECODED)
HEX_CTES = (T, WIRED, MASKED, HEXED)

# ------------------------------------------------------------------ lines and packets

oracle("rx_payloads", """
SELECT event_id, line_pos, line,
 CASE WHEN NOT starts_with(head, '-') AND len(tokens) >= 3
      THEN lower(array_to_string(tokens, '')) END AS payload_hex
FROM (SELECT *, regexp_extract_all(head, '\\b[0-9A-Fa-f]{2}\\b') AS tokens
      FROM (SELECT *, trim(split_part(line, ',', 1)) AS head FROM kept) AS h) AS x""",
       """b AS (SELECT event_id, array_to_string(list_transform(range(1, (2 + event_id % 20)::BIGINT),
 lambda i: lpad(lower(to_hex((c * i) % 256)), 2, '0')), ' ') AS body FROM e)""",
       """kept AS (SELECT event_id, CASE WHEN event_id % 10 = 5 THEN 1 ELSE 0 END AS line_pos,
 CASE event_id % 10 WHEN 3 THEN 'b502aa55' WHEN 5 THEN body WHEN 7 THEN '-48,13'
 ELSE 'Data: (HEX:) ' || body || ' ,-33,13' END AS line
 FROM b WHERE event_id % 10 <> 0)""")

oracle("encode_packet", """SELECT * REPLACE (
 CASE WHEN encode_error IS NULL THEN field_mask END AS field_mask,
 CASE WHEN encode_error IS NULL THEN clamped ELSE '' END AS clamped) FROM hexed""", *HEX_CTES)

_kind = f"({f.CORRUPT})"
_reason = f"CASE {_kind} " + " ".join(
    f"WHEN {n} THEN '{text}'" for n, text in f.CORRUPT_REASONS.items()) + " END"
_keep = ["version", "msg_type", "event_type", "device_id", "seq", "packet_ts", "field_mask",
         *all_decoded_columns()]
oracle("decode_packet",
       f"SELECT event_id, {_reason} AS reject_reason, "
       + ", ".join(f"CASE WHEN {_kind} IS NULL THEN {c} END AS {c}" for c in _keep)
       + " FROM d", *PACKET_CTES)

oracle("batch_build", f"""
SELECT session_id, tick, n_packets, frame_bytes,
 CASE WHEN n_packets > 255 THEN 'too many packets'
      WHEN frame_bytes > 180 THEN 'frame too long' END AS build_error,
 CASE WHEN n_packets <= 255 AND frame_bytes <= 180
      THEN 'b5' || {hx('n_packets', 1)} || parts END AS frame_hex
FROM (SELECT session_id, floor(t_us / 3600000000)::BIGINT AS tick, count(*) AS n_packets,
  sum(length(packet_hex) // 2 + 1) + 2 AS frame_bytes,
  string_agg({hx('length(packet_hex) // 2', 1)} || packet_hex, '' ORDER BY event_id) AS parts
 FROM hexed WHERE packet_hex IS NOT NULL GROUP BY 1, 2) AS g""", *HEX_CTES)

oracle("batch_split", """
SELECT event_id, 0 AS element_pos,
 CASE event_id % 23 WHEN 0 THEN 'truncated: element shorter than declared'
  WHEN 1 THEN 'trailing bytes' WHEN 2 THEN 'truncated: missing length byte'
  ELSE 'not a batch frame' END AS reject_reason, NULL AS element_hex
FROM e WHERE event_id % 23 < 4
UNION ALL
SELECT event_id, i - 1, NULL, array_to_string(list_transform(
  range(1, (4 + (event_id + i) % 5)::BIGINT),
  lambda q: lpad(lower(to_hex((c * q + i) % 256)), 2, '0')), '')
FROM (SELECT *, unnest(range(1, (2 + event_id % 4)::BIGINT)) AS i FROM e
      WHERE event_id % 23 >= 4) AS u""")

_line_cols = ("msg_type, device_id, seq, packet_ts, field_mask, voltage_mv, motor_temp_c, "
              "soc_pct, pv_voltage_v")
_no_cols = ", ".join(f"NULL AS {c}" for c in _line_cols.split(", "))
_no_text = "NULL AS text, NULL AS text_kind, NULL AS num"
LINE_SQL = f"""
SELECT event_id, 'packet' AS origin, 0 AS element_pos, NULL AS reject_reason, {_line_cols},
 {_no_text} FROM d WHERE event_id % 10 > 5
UNION ALL
SELECT event_id, 'batch', pos, NULL, {_line_cols}, {_no_text}
FROM (SELECT *, unnest([0, 1]) AS pos FROM d WHERE event_id % 10 IN (1, 2)) AS b
WHERE event_id % 10 = 1 OR pos = 0
UNION ALL
SELECT event_id, 'batch', 1, 'crc mismatch', {_no_cols}, {_no_text} FROM d WHERE event_id % 10 = 2
UNION ALL
SELECT event_id, 'batch', 0, 'truncated: element shorter than declared', {_no_cols}, {_no_text}
FROM d WHERE event_id % 10 = 3
UNION ALL
SELECT event_id, 'ascii', 0, NULL, 'ASCII', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
 'k=' || (event_id % 1000) || ',v=-1.5', 'kv',
 'k=' || (event_id % 1000 * 1000) || ';v=-1500' FROM d WHERE event_id % 10 = 4
UNION ALL
SELECT event_id, 'packet', 0, 'too short', {_no_cols}, {_no_text} FROM d WHERE event_id % 10 = 5"""
oracle("decode_line", LINE_SQL, *PACKET_CTES)
oracle("streaming_decode", LINE_SQL, *PACKET_CTES)
oracle("reject_table", f"""
SELECT *, origin AS stage FROM ({LINE_SQL}) AS l WHERE reject_reason IS NOT NULL""", *PACKET_CTES)
for _name in ("scan_rx_lines", "streaming_scan_rx_lines"):
    oracle(_name, """
SELECT * FROM (SELECT session_id, line_no, trim(line, ' ' || chr(13)) AS line FROM (
 SELECT session_id, unnest(range(len(l) - 1)) AS line_no, unnest(l[1:len(l) - 1]) AS line FROM (
  SELECT session_id, string_split(string_agg(
    replace(raw, chr(10), '|') || CASE WHEN event_id % 3 = 0 THEN 'é' ELSE '' END
    || CASE WHEN event_id % 5 = 0 THEN '' ELSE chr(10) END, '' ORDER BY event_id), chr(10)) AS l
  FROM log GROUP BY session_id) AS a) AS b) AS c WHERE line <> ''""",
           """log AS (SELECT event_id, session_id, CASE event_id % 10
 WHEN 0 THEN 'rxDone' || chr(13) || chr(10) || 'Rssi= -' || event_id WHEN 3 THEN 'b502aa55'
 WHEN 5 THEN 'null' || chr(13) || chr(10) || '  ' || body WHEN 7 THEN '-48,13'
 ELSE ' Data: (HEX:) ' || body || ' ,-33,13' || chr(13) || chr(10) || chr(13) || chr(10) || 'OK'
  || chr(13) || chr(10) END AS raw FROM (SELECT *, array_to_string(list_transform(
   range(1, (2 + event_id % 20)::BIGINT), lambda i: lpad(lower(to_hex((c * i) % 256)), 2, '0')), ' ')
  AS body FROM e) AS b)""")

oracle("ascii_events", """
SELECT event_id, text, kind AS text_kind,
 CASE kind WHEN 'json' THEN CASE event_id % 7
   WHEN 0 THEN 'k=' || (regexp_extract(props, '[0-9]+')::BIGINT * 1000)
   ELSE 'flag=1000;n=' || (c * 1000) || ';temp=12500' END
  WHEN 'kv' THEN 'k=' || (c * 1000) || ';v=-1500'
  WHEN 'scalar' THEN 'value=' || (c * 1000 + 250)
  WHEN 'csv' THEN 'value_0=' || (c * 1000) || ';value_1=2000;value_2=3000;value_3=4000;value_4=5000'
  WHEN 'text' THEN '' END AS num,
 CASE WHEN kind IS NULL THEN NULL WHEN event_id % 7 = 1 THEN 'name=bob' ELSE '' END AS str,
 CASE WHEN event_id % 7 = 6 THEN 'fffe' || lower(to_hex(encode(c::VARCHAR)))
  WHEN event_id % 7 = 5 THEN '00' || lower(to_hex(encode(text)))
  WHEN event_id % 7 = 3 THEN '20' || lower(to_hex(encode(text))) || '20'
  ELSE lower(to_hex(encode(text))) END AS payload_hex
FROM (SELECT *, CASE event_id % 7 WHEN 0 THEN props
  WHEN 1 THEN '{"Temp": "12.5", "Name": "bob", "Flag": true, "Null": null, "Nest": {"a": 1}, "N": ' || c || '}'
  WHEN 2 THEN 'k=' || c || ',V=-1.5;z=abc' WHEN 3 THEN c || '.25'
  WHEN 4 THEN c || ', 2, 3,4,5,6,7' WHEN 5 THEN 'hello-' || c END AS text,
 CASE event_id % 7 WHEN 0 THEN 'json' WHEN 1 THEN 'json' WHEN 2 THEN 'kv' WHEN 3 THEN 'scalar'
  WHEN 4 THEN 'csv' WHEN 5 THEN 'text' END AS kind FROM e) AS x""")

# ------------------------------------------------------------------ captures

SHUNT_BLOCKS = """s AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY event_id) AS rn
 FROM r),
blocks AS (
 SELECT event_id, session_id, t_us, 2 * (rn - 1) AS block_no, event_id * 32 + 7 AS end_line,
  6 + (CASE WHEN event_id % 5 <> 0 THEN 1 ELSE 0 END)
    + (CASE WHEN event_id % 37 = 0 THEN 1 ELSE 0 END) AS n_lines,
  CASE WHEN event_id % 31 = 0 THEN 1 ELSE 0 END AS byte_sum_mod,
  voltage_mv::VARCHAR AS v, current_ma::VARCHAR AS i,
  CASE WHEN event_id % 5 <> 0 THEN power_w::VARCHAR END AS p,
  ((c * 3) % 1001)::VARCHAR AS soc, 'OFF' AS alarm, alarm::VARCHAR AS ar,
  NULL::VARCHAR AS h1, NULL::VARCHAR AS h2
 FROM s
 UNION ALL
 SELECT event_id, session_id, t_us, 2 * (rn - 1) + 1, event_id * 32 + 19,
  3 + (CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END), 0,
  NULL::VARCHAR, NULL::VARCHAR, CASE WHEN event_id % 5 = 0 THEN power_w::VARCHAR END,
  NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR,
  (-c)::VARCHAR, (c % 777)::VARCHAR
 FROM s)"""
_pairs = {"AR": "ar", "Alarm": "alarm", "H1": "h1", "H2": "h2", "I": "i", "P": "p",
          "SOC": "soc", "V": "v"}
_field_text = joined([f"'{k}=' || {v}" for k, v in _pairs.items()])
oracle("vedirect_blocks", f"""
SELECT session_id, block_no, end_line, n_lines, n_lines AS n_text_lines, byte_sum_mod,
 byte_sum_mod = 0 AS ok, CASE WHEN byte_sum_mod = 0 THEN {_field_text} END AS fields
FROM blocks""", R, SHUNT_BLOCKS)

_cols = ["v", "i", "p", "soc", "alarm", "ar", "h1", "h2"]
_first = ", ".join(_cols)
_next = ", ".join(
    f"coalesce(b.{c}, CASE WHEN w.returned THEN NULL ELSE w.{c} END) AS {c}" for c in _cols)
_full = " AND ".join(
    f"coalesce(b.{c}, CASE WHEN w.returned THEN NULL ELSE w.{c} END) IS NOT NULL"
    for c in ("v", "i", "p"))
WALK = f"""valid AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY block_no) AS n
 FROM blocks WHERE byte_sum_mod = 0),
walk AS (SELECT session_id, n, block_no, {_first},
  v IS NOT NULL AND i IS NOT NULL AND p IS NOT NULL AS returned, block_no AS started,
  1::BIGINT AS held
 FROM valid WHERE n = 1
 UNION ALL
 SELECT b.session_id, b.n, b.block_no, {_next}, {_full} AS returned,
  CASE WHEN w.returned THEN b.block_no ELSE w.started END,
  CASE WHEN w.returned THEN 1 ELSE w.held + 1 END
 FROM walk AS w JOIN valid AS b ON b.session_id = w.session_id AND b.n = w.n + 1)"""
oracle("vedirect_frames", f"SELECT session_id, block_no AS end_block, {_first} "
       "FROM walk WHERE returned", R, SHUNT_BLOCKS, WALK, recursive=True)

_have = joined([f"CASE WHEN {v} IS NOT NULL THEN '{k}' END" for k, v in _pairs.items()], ",")
_miss = ("array_to_string(list_filter([CASE WHEN v IS NULL THEN 'V' END, "
         "CASE WHEN i IS NULL THEN 'I' END, CASE WHEN p IS NULL THEN 'P' END], "
         "lambda x: x IS NOT NULL), ',')")
oracle("missing_block_runs", f"""
SELECT session_id, started AS first_block, block_no AS last_block, held AS n_blocks,
 {_miss} AS missing_keys, {_have} AS have_keys
FROM (SELECT *, lead(returned) OVER (PARTITION BY session_id ORDER BY n) AS next_returned
      FROM walk) AS w
WHERE NOT returned AND held >= 2 AND coalesce(next_returned, true)""",
       R, SHUNT_BLOCKS, WALK, recursive=True)

oracle("vedirect_health", """
SELECT session_id, floor(t_us / 5000000)::BIGINT * 5 AS window_s, sum(n_lines) AS lines,
 count(*) AS blocks, sum(CASE WHEN byte_sum_mod <> 0 THEN 1 ELSE 0 END) AS checksum_failures
FROM blocks GROUP BY 1, 2""", R, SHUNT_BLOCKS)

POLLS = ("polls AS (SELECT o_orderkey AS k, o_orderkey % 8 AS session_id FROM orders), "
         f"pv AS (SELECT *, {f.PACK_CV} AS pack_cv FROM polls)")
_ranges = ", ".join(f"({s}, {n})" for s, n in dim.request_chunks())
_reply_reason = f"CASE {f.REPLY_FAULT} " + " ".join(
    f"WHEN {n} THEN '{text}'" for n, text in f.REPLY_REASONS.items()) + " END"
REPLIES = f"""chunks(start, n) AS (VALUES {_ranges}),
asked AS (SELECT pv.*, chunks.start, chunks.n, {_reply_reason} AS reject_reason,
  list_transform(range(chunks.start, chunks.start + chunks.n),
   lambda reg: ({f.register('reg')})::BIGINT) AS regs
 FROM pv, chunks WHERE NOT (k % 23 = 0 AND chunks.start = 32))"""
oracle("modbus_replies", """
SELECT k, start, reject_reason,
 CASE WHEN reject_reason IS NULL THEN n END AS n_regs,
 CASE WHEN reject_reason IS NULL THEN list_sum(regs) END AS reg_sum,
 CASE WHEN reject_reason IS NULL THEN regs[1] END AS first_reg,
 CASE WHEN reject_reason IS NULL THEN regs[n] END AS last_reg FROM asked""", POLLS, REPLIES)
_reads = [(a, n, 0, "true") for a, n in dim.request_chunks()] + list(inputs.AGAIN)
_required = ", ".join(map(str, sorted(dim.BATTERY_REGISTERS.values())))
oracle("modbus_snapshot", f"""
SELECT k, count(*) AS n_registers, sum(v) AS reg_sum, max(CASE WHEN reg = 21 THEN v END) AS soc,
 array_to_string(list_filter([{_required}], lambda r: NOT list_contains(list(reg), r)), ',')
  AS missing
FROM (SELECT k, reg, arg_max(v, turn) AS v FROM (
  SELECT k, reg, turn, (({f.register('reg')}) + add)::BIGINT % 65536 AS v FROM (
   SELECT pv.*, turn, add, unnest(range(start, start + n)) AS reg
   FROM pv, (VALUES {", ".join(f"({a}, {n}, {d}, {t})" for t, (a, n, d, _) in enumerate(_reads))})
    AS w(start, n, add, turn)
   WHERE NOT (k % 23 = 0 AND start = 32)
    AND ({" OR ".join(f"(turn = {t} AND {c})" for t, (_, _, _, c) in enumerate(_reads))})) AS x) AS y
 GROUP BY k, reg) AS z
WHERE k IN (SELECT k FROM asked GROUP BY k HAVING count(reject_reason) = 0) GROUP BY k""",
       POLLS, REPLIES)

_bytes = ("array_to_string(list_transform(range(1, (1 + size)::BIGINT), "
          "lambda p: lpad(lower(to_hex((c * p) % 256)), 2, '0')), '')")
BUS = f"""f0 AS (SELECT event_id, t_us, session_id, c, {f.CAN_ID} AS can_id,
 {f.FRAME_SIZE} AS size FROM e),
f1 AS (SELECT *, {_bytes} AS data_hex, can_id // 16 AS board, can_id % 16 AS packet_id FROM f0)"""
_index = "CASE board " + " ".join(
    f"WHEN {b} THEN {n}" for n, b in enumerate(dim.BOARD_IDS)) + " END"
_mapped = f"board IN ({', '.join(map(str, dim.BOARD_IDS))}) AND packet_id IN (0, 1)"
_sound = "event_id % 43 <> 0 AND event_id % 47 <> 0"
oracle("can_frames", f"""
SELECT event_id, can_id, 'mppt' AS kind, {_index} AS mppt_index, packet_id, size AS dlc,
 data_hex, packet_id = 0 AS passes_filter FROM f1 WHERE {_mapped} AND {_sound}""", BUS)

oracle("rtd_conversions", f"""
SELECT event_id, {f.RTD_CODE} AS raw_code,
 CASE WHEN {f.RTD_FAULT} = 1 THEN {f.RTD_FAULT_STATUS} ELSE 0 END AS fault_status,
 CASE WHEN event_id % 53 = 0 THEN 'config mismatch' END AS reject_reason FROM e""")

oracle("modem_reply_class", """
SELECT event_id // 3 AS send_id, count(*) AS lines,
 bool_or(event_type IN ('click', 'error') OR (event_type = 'signup' AND c % 4 = 3)) AS is_error,
 bool_or(event_type = 'purchase') AS needs_reset,
 bool_or(event_type = 'signup' AND c % 4 < 3) AS send_failed
FROM e GROUP BY 1""")

# ------------------------------------------------------------------ normalisers

oracle("normalize_bmv", """
SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 0 ELSE voltage_mv END AS voltage_mv,
 CASE WHEN event_id % 19 = 0 THEN c ELSE current_ma END AS current_ma,
 CASE WHEN event_id % 23 = 0 THEN 0 ELSE power_w END AS power_w,
 CASE WHEN event_id % 13 <> 0 THEN ((c * 3) % 1001)::DOUBLE / 10 END AS charge_state,
 CASE WHEN event_id % 4 = 0 THEN c % 5 WHEN event_id % 6 = 1 THEN 0 ELSE alarm END AS alarm
FROM r""", R)

_cells = "[" + ", ".join(f.cell(str(n)) for n in range(1, 17)) + "]"


def fitted_stats(cells: str) -> str:
    """Columns of the fitted cells' extremes of a list column."""
    fit = f"list_filter({cells}, lambda m: m >= 1000)"
    return (f"list_max({fit}) AS cell_v_max_mv, list_min({fit}) AS cell_v_min_mv, "
            f"list_max({fit}) - list_min({fit}) AS cell_v_delta_mv, "
            f"list_position({cells}, list_max({fit})) AS cell_max_idx, "
            f"list_position({cells}, list_min({fit})) AS cell_min_idx, "
            f"list_sum({fit})::DOUBLE / 1000 AS cell_sum_v, len({fit}) AS fitted")


BATTERY = f"""pc AS (SELECT *, {_cells} AS cells_mv, k % 120 - 20 AS temp FROM pv),
bat AS (SELECT *, {fitted_stats('cells_mv')}, ({f.register('22')}) AS reg22,
 ({f.register('23')}) AS reg23, ({f.register('26')}) AS reg26, ({f.register('27')}) AS reg27,
 ({f.register('30')}) AS reg30, ({f.register('32')}) AS reg32 FROM pc)"""
_unident = " || ';' || ".join(
    f"'{r}=' || ({f.register(str(r))})" for r in dim.UNIDENTIFIED_REGISTERS)
oracle("normalize_bms", f"""
SELECT *, CASE WHEN k % 23 = 0 THEN 'missing registers 26' END AS reject_reason,
 reg22::DOUBLE / 100 AS battery_voltage_v,
 (CASE WHEN reg23 >= 32768 THEN reg23 - 65536 ELSE reg23 END)::DOUBLE / 100 AS battery_current_a,
 k % 104 AS soc_pct, reg32 AS soh_pct,
 CASE WHEN k % 23 <> 0 THEN reg26::DOUBLE / 100 END AS remaining_ah,
 reg27::DOUBLE / 100 AS full_capacity_ah, reg30 AS cycle_count, temp AS temp_max_c,
 16 AS cell_count, array_to_string(cells_mv, ',') AS cells, {_unident} AS unidentified
FROM bat""", POLLS, BATTERY)

oracle("cell_stats", f"""
SELECT vec_id, pack, {fitted_stats('cells')} FROM (SELECT vec_id, pack, list_transform(range(1, 17),
 lambda p: CASE WHEN vec_id % 7 = 0 AND p = 5 THEN 0
  ELSE floor(3300 + embedding[16 * pack + p]::DOUBLE * 100)::BIGINT END) AS cells
 FROM (SELECT *, unnest(range(4)) AS pack FROM embeddings) AS y) AS x""")


def _s16(a: str, b: str) -> str:
    raw = f"(((c * {a}) % 256) * 256 + (c * {b}) % 256)"
    return f"(CASE WHEN {raw} >= 32768 THEN {raw} - 65536 ELSE {raw} END)"


_s8 = "(CASE WHEN (c * {n}) % 256 >= 128 THEN (c * {n}) % 256 - 256 ELSE (c * {n}) % 256 END)"


def _named(code: str, names) -> str:
    return f"CASE {code} " + " ".join(
        f"WHEN {n} THEN '{text}'" for n, text in enumerate(names)
    ) + f" ELSE 'Unknown(' || ({code}) || ')' END"


MPPT = f"""m0 AS (SELECT *, {_mapped} AS mapped, {_index} AS board_index FROM f1),
m AS (SELECT *, mapped AND packet_id = 0 AS power, mapped AND packet_id = 1 AS status,
 {_s16('1', '2')}::DOUBLE * 0.01e0 AS pv, {_s16('3', '4')}::DOUBLE * 0.0005e0 AS pa FROM m0)"""
oracle("normalize_mppt", f"""
SELECT event_id, CASE WHEN mapped THEN board_index + 1 END AS device_id,
 CASE WHEN mapped THEN board_index END AS mppt_index, packet_id,
 CASE WHEN NOT mapped THEN 'unmapped can_id' END AS reject_reason,
 CASE WHEN power THEN pv END AS pv_voltage_v, CASE WHEN power THEN pa END AS pv_current_a,
 CASE WHEN power THEN {py_round('(pv * pa)', 3)} END AS pv_power_w,
 CASE WHEN power THEN {_s16('5', '6')}::DOUBLE * 0.01e0 END AS battery_voltage_v,
 CASE WHEN power THEN {_s16('7', '8')}::DOUBLE * 0.0005e0 END AS battery_current_a,
 CASE WHEN status THEN c % 256 END AS mode,
 CASE WHEN status THEN {_named('c % 256', dim.MODE_NAMES)} END AS mode_name,
 CASE WHEN status THEN (c * 2) % 256 END AS fault,
 CASE WHEN status THEN {_named('(c * 2) % 256', dim.FAULT_NAMES)} END AS fault_name,
 CASE WHEN status THEN (c * 3) % 256 END AS enabled,
 CASE WHEN status THEN {_s8.format(n=4)} END AS ambient_temp_c,
 CASE WHEN status THEN {_s8.format(n=5)} END AS heatsink_temp_c,
 rpad(data_hex, 16, '0') AS raw_hex FROM m""", BUS, MPPT)

_disc = "(3.9083e-3 * 3.9083e-3 - 4 * -5.775e-7 * (1e0 - ohm / 100e0))"
_warm = f"((sqrt({_disc}) - 3.9083e-3) / (2 * -5.775e-7))"
_ratio = "(ohm / 100e0 * 100e0)"
_cold = "1.5243e-10"
for _k in ("-2.8183e-8", "-4.8260e-6", "2.5859e-3", "2.2228e0", "-242.02e0"):
    _cold = f"({_cold} * {_ratio} + {_k})"
_names = ("array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN fault & {bit} <> 0 THEN '{name}' END" for bit, name in dim.SENSOR_FAULT_BITS)
    + "], lambda x: x IS NOT NULL), '|')")
RTD = f"""q0 AS (SELECT event_id, {f.RTD_CODE} AS raw_code,
  CASE WHEN {f.RTD_FAULT} = 1 THEN {f.RTD_FAULT_STATUS}
       WHEN {f.RTD_CODE} = 0 THEN 1 ELSE 0 END AS fault FROM e WHERE event_id % 53 <> 0),
q1 AS (SELECT *, CASE WHEN fault = 0 THEN raw_code::DOUBLE * 430e0 / 32768e0 END AS ohm FROM q0),
q AS (SELECT *, CASE WHEN {_warm} >= 0 THEN {_warm} ELSE {_cold} END AS deg FROM q1)"""
oracle("normalize_rtd", f"""
SELECT event_id, raw_code, fault, {_names} AS fault_name,
 {py_round('ohm', 3)} AS resistance_ohm, {py_round('deg', 2)} AS motor_temp_c,
 {py_round('(deg * 9e0 / 5e0 + 32e0)', 2)} AS motor_temp_f FROM q""", RTD)

_violations = """list_filter([
  CASE WHEN abs(cell_sum_v - reg22::DOUBLE / 100) > 1 THEN 'cell sum differs from pack voltage' END,
  CASE WHEN fitted = 0 THEN 'no cell voltages' END,
  CASE WHEN k % 104 > 100 THEN 'soc above 100' END], lambda x: x IS NOT NULL)"""
oracle("quality_rules", f"SELECT k, array_to_string({_violations}, '; ') AS violations FROM bat",
       POLLS, BATTERY)

oracle("flatten_event", f"""
SELECT k, 'soc_pct' AS path, (k % 104)::DOUBLE AS num, NULL AS str FROM bat
UNION ALL SELECT k, 'cells_mv_' || p, cells_mv[p + 1]::DOUBLE, NULL
 FROM (SELECT *, unnest(range(16)) AS p FROM bat) AS a
UNION ALL SELECT k, 'violations_' || p, NULL, v[p + 1] FROM (
 SELECT k, v, unnest(range(len(v))) AS p FROM (SELECT k, {_violations} AS v FROM bat) AS b) AS c
UNION ALL SELECT k, 'more_raw_unidentified_' || r, x::DOUBLE, NULL FROM (
 SELECT k, unnest([{", ".join(str(r) for r in dim.UNIDENTIFIED_REGISTERS)}]) AS r,
  unnest([{", ".join(f"({f.register(str(r))})::BIGINT" for r in dim.UNIDENTIFIED_REGISTERS)}]) AS x
 FROM bat) AS d""", POLLS, BATTERY)

_labels = ", ".join(f"({r}, '{text}')" for r, text in dim.REGISTER_LABELS)
oracle("register_profile", """
SELECT reg, coalesce(label, '') AS label, count(*) AS polls, min(u) AS u16_min, max(u) AS u16_max,
 min(CASE WHEN u >= 32768 THEN u - 65536 ELSE u END) AS s16_min,
 max(CASE WHEN u >= 32768 THEN u - 65536 ELSE u END) AS s16_max, sum(u) AS u16_sum,
 '0x' || upper(lpad(to_hex(max(u)), 4, '0')) AS hex_max, count(pair) AS ascii_polls,
 max(pair) AS ascii_max
FROM (SELECT *, CASE WHEN u // 256 BETWEEN 32 AND 126 AND u % 256 BETWEEN 32 AND 126
   THEN chr((u // 256)::INT) || chr((u % 256)::INT) END AS pair FROM dump) AS x
 LEFT JOIN labels USING (reg) GROUP BY reg, label""",
       POLLS, f"labels(reg, label) AS (VALUES {_labels})",
       f"""dump AS (SELECT k, reg, ({f.register('reg')})::BIGINT AS u FROM
 (SELECT *, unnest(range(0, 42) || range(113, 129)) AS reg FROM pv) AS y
 WHERE NOT (k % 23 = 0 AND reg = 26))""")

# ------------------------------------------------------------------ events and points

TEXTS = """texts AS (SELECT event_id, t_us + 2000000 AS received_us, c,
 CASE event_id % 2 WHEN 0 THEN 'hello-' || c ELSE 'temp=' || c END AS text
 FROM e WHERE event_type = 'error')"""
_scaled = [f"CASE WHEN {c} IS NOT NULL THEN '{c2}=' || (round_even({c}::DOUBLE * 1e4, 0)::BIGINT) END"
           for c, c2 in [("version", "version"), (EVENT_CODE, "event_type"), ("seq", "seq"),
                         ("packet_ts", "timestamp"), ("field_mask", "field_mask"),
                         *[(c, f"fields_{c}") for c in all_decoded_columns()]]]
_bucket = "CASE msg_type " + " ".join(
    f"WHEN '{t}' THEN '{b}'" for t, b in dim.BUCKETS.items()) + f" ELSE '{dim.DEFAULT_BUCKET}' END"
oracle("influx_points", f"""
SELECT event_id, 'telemetry' AS measurement, {_bucket} AS bucket,
 'device_id=' || device_id || ';msg_type=' || msg_type || ';port=p0;source=receiver' AS tags,
 {joined(_scaled)} AS num, '' AS str, received_us AS time_us FROM d
UNION ALL
SELECT event_id, 'telemetry', '{dim.DEFAULT_BUCKET}', 'msg_type=ASCII;port=p0;source=receiver',
 CASE event_id % 2 WHEN 0 THEN 'received=10000' ELSE 'temp=' || (c * 10000) END,
 'payload=' || text, received_us FROM texts""", *PACKET_CTES, TEXTS)

_plain = ("regexp_replace(regexp_replace({c}::DECIMAL(18,4)::VARCHAR, '0+$', ''), "
          "'\\.$', '.0')")


def _line_sql(t: str) -> str:
    whole = {x.name for x in LAYOUTS[t] if x.divisor == 1}
    parts = [f"'''{c}'': ' || " + (f"{c}::BIGINT::VARCHAR" if c in whole else _plain.format(c=c))
             for c in decoded_columns(t) if not (t == "BMS" and c == "soc_pct")]
    return (f"'[rx:{t.lower()}] event=' || event_type || ' device=' || device_id || ' seq=' || seq "
            "|| ' timestamp=' || strftime(make_timestamp(packet_ts * 1000000), "
            "'%Y-%m-%dT%H:%M:%S') || '+00:00 fields={' || concat_ws(', ', "
            + ", ".join(parts) + ") || '}'")


oracle("format_packet_line",
       f"SELECT event_id, {_case(lambda t, _: _line_sql(t))} AS line FROM d", *PACKET_CTES)
oracle("union_all_types", "SELECT * FROM d", *PACKET_CTES)

# ------------------------------------------------------------------ ordered analyses

oracle("asof_latest_at_tick", """
SELECT k.session_id, tick_us, t_us, (tick_us - t_us) / 1e6 AS staleness_s, event_id, current_ma
FROM k ASOF JOIN (SELECT * FROM r QUALIFY row_number() OVER (
 PARTITION BY session_id, t_us ORDER BY event_id DESC) = 1) AS r
 ON k.session_id = r.session_id AND k.tick_us >= r.t_us""", R,
       """k AS (SELECT session_id, unnest(range(floor(lo / 21600000000)::BIGINT * 21600000000,
  hi + 1, 21600000000)) AS tick_us
 FROM (SELECT session_id, min(t_us) AS lo, max(t_us) AS hi FROM e GROUP BY 1) AS g)""")

STARTS = f"""starts AS (SELECT session_id, min(t_us) AS s FROM r
 WHERE current_ma::DOUBLE / 1000 < -{j.DRIVE_A} GROUP BY 1)"""
oracle("drive_elapsed", """
SELECT event_id, r.session_id, greatest(coalesce(floor((t_us - s) / 1e6), 0), 0) AS elapsed_s
FROM r LEFT JOIN starts USING (session_id)""", R, STARTS)

oracle("peak_hold", """
SELECT *, min(CASE WHEN current_ma < 0 THEN current_ma END) OVER (
  PARTITION BY session_id, epoch ORDER BY t_us, event_id) AS peak_current_ma
FROM (SELECT *, coalesce(sum(CASE WHEN tx_ok THEN 1 ELSE 0 END) OVER (PARTITION BY session_id
  ORDER BY t_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch
 FROM r) AS x""", R)

GAPS = """rx AS (SELECT session_id, msg_type, seq, event_id AS arrival FROM t
 WHERE event_id % 17 <> 0),
g0 AS (SELECT *, lag(seq) OVER (PARTITION BY session_id, msg_type ORDER BY arrival) AS prev_seq
 FROM rx),
g1 AS (SELECT *, (seq - prev_seq - 1 + 65536) % 65536 AS gap FROM g0),
g AS (SELECT *, CASE WHEN gap > 0 AND gap < 4096 THEN gap ELSE 0 END AS lost FROM g1)"""
oracle("seq_gap", "SELECT * FROM g", T, GAPS)
oracle("streaming_seq_gap", "SELECT * FROM g", T, GAPS)
oracle("running_loss", """
SELECT *, 100e0 * total_lost / (received + total_lost) AS loss_pct FROM (
 SELECT *, row_number() OVER w AS received, (sum(lost) OVER w)::BIGINT AS total_lost FROM g
 WINDOW w AS (PARTITION BY session_id ORDER BY arrival)) AS x WHERE lost > 0""", T, GAPS)
oracle("session_loss", """
SELECT *, 100e0 * lost / (received + lost) AS loss_pct FROM (
 SELECT session_id, count(*) AS received, sum(lost)::BIGINT AS lost FROM g GROUP BY 1) AS x""",
       T, GAPS)
oracle("seq_assign", """
SELECT event_id, session_id, upper(event_type) AS msg_type, (row_number() OVER (
 PARTITION BY session_id, event_type ORDER BY t_us, event_id) - 1) % 65536 AS seq FROM e""")

oracle("tx_stats", """
SELECT session_id, event_type AS stream, floor(t_us / 5000000)::BIGINT * 5 AS window_s,
 sum(CASE WHEN tx_ok THEN 1 ELSE 0 END) AS n_ok,
 sum(CASE WHEN tx_ok THEN 0 ELSE 1 END) AS n_failed FROM r GROUP BY 1, 2, 3""", R)

LOG = """log AS (SELECT event_id AS poll_id, t_us, session_id,
 CASE user_id % 2 WHEN 0 THEN 'bms' ELSE 'rtd' END AS stream, event_type <> 'error' AS ok,
 event_id % 29 = 0 AS has_fault, 'timeout ' || (c % 5) AS error FROM e)"""
oracle("poll_health", """
SELECT session_id, stream, floor(t_us / 3600000000)::BIGINT * 3600 AS window_s,
 count(*) FILTER (WHERE ok) AS n_ok, count(*) FILTER (WHERE NOT ok) AS n_failed,
 count(*) FILTER (WHERE ok AND has_fault) AS n_fault,
 arg_max(error, poll_id) FILTER (WHERE NOT ok) AS last_error
FROM log GROUP BY 1, 2, 3""", LOG)
oracle("poll_error_runs", """
SELECT *, least(2e0 * consecutive, 10) AS backoff_s, consecutive >= 3 AS gives_up FROM (
 SELECT *, row_number() OVER (PARTITION BY session_id, stream, island ORDER BY poll_id)
  AS consecutive
 FROM (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, stream
   ORDER BY poll_id) AS island FROM log) AS x WHERE NOT ok) AS y""", LOG)

oracle("priority_rank", """
SELECT *, send_rank = 1 AS is_next FROM (
 SELECT *, row_number() OVER (PARTITION BY session_id, tick ORDER BY priority, arrival) AS send_rank
 FROM (SELECT session_id, floor(t_us / 86400000000)::BIGINT AS tick, event_id AS arrival,
  CASE event_type WHEN 'view' THEN 0 WHEN 'purchase' THEN 5 WHEN 'signup' THEN 7 ELSE 10 END
  AS priority FROM e) AS x) AS y""")

# One recursion step looks at one slot; a finished tick hands its position to the next.
oracle("batch_assembly", """
SELECT session_id, tick, n_picked - 1 AS frame_pos, name AS slot, size AS packet_bytes
FROM look WHERE took""",
       """due AS (SELECT session_id, floor(t_us / 21600000000)::BIGINT AS tick, user_id % 7 AS slot,
  max(CASE WHEN event_id % 3 = 0 THEN 0 ELSE 20 + c % 50 END) AS size FROM e GROUP BY 1, 2, 3),
cached AS (SELECT t.session_id, t.tick, f.slot, coalesce(d.size, 0) AS size,
  row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY t.session_id, t.tick) AS n
 FROM (SELECT DISTINCT session_id, tick FROM due) AS t
 JOIN (SELECT session_id, slot, min(tick) AS since FROM due GROUP BY 1, 2) AS f
  ON f.session_id = t.session_id AND f.since <= t.tick
 LEFT JOIN due AS d ON d.session_id = t.session_id AND d.tick = t.tick AND d.slot = f.slot
 WINDOW w AS (PARTITION BY t.session_id, t.tick ORDER BY f.since, f.slot)),
ticked AS (SELECT *, dense_rank() OVER (PARTITION BY session_id ORDER BY tick) AS tn FROM cached),
sized AS (SELECT session_id, tn, any_value(tick) AS tick, any_value(n) AS n,
  list(size ORDER BY pos) AS sizes, list(slot ORDER BY pos) AS names FROM ticked GROUP BY 1, 2),
look AS (
 SELECT session_id, tn, tick, n, sizes, names, 0::BIGINT AS name, 0::BIGINT AS slot, 0::BIGINT AS size, 0::BIGINT AS at,
  0::BIGINT AS checked, 2::BIGINT AS used, 0::BIGINT AS n_picked, false AS took, false AS done
 FROM sized WHERE tn = 1
 UNION ALL
 SELECT l.session_id, z.tn, z.tick, z.n, z.sizes, z.names, z.names[s.slot + 1], s.slot, s.size, (s.slot + 1) % z.n,
  s.checked + 1, s.used + CASE WHEN s.took THEN 1 + s.size ELSE 0 END,
  s.picked + CASE WHEN s.took THEN 1 ELSE 0 END, s.took,
  s.overflow OR s.checked + 1 >= z.n OR s.picked + (CASE WHEN s.took THEN 1 ELSE 0 END) >= 4
 FROM look AS l
 JOIN sized AS z ON z.session_id = l.session_id
  AND z.tn = l.tn + CASE WHEN l.done THEN 1 ELSE 0 END,
 LATERAL (SELECT l.at % z.n AS slot) AS p,
 LATERAL (SELECT p.slot, z.sizes[p.slot + 1] AS size,
  CASE WHEN l.done THEN 0 ELSE l.checked END AS checked,
  CASE WHEN l.done THEN 2 ELSE l.used END AS used,
  CASE WHEN l.done THEN 0 ELSE l.n_picked END AS picked) AS q,
 LATERAL (SELECT q.*, q.size > 0 AND q.used + 1 + q.size <= 180 AS took,
  q.size > 0 AND q.used + 1 + q.size > 180 AS overflow) AS s)""", recursive=True)

# ------------------------------------------------------------------ send policies


def fold_sql(name: str, rows: str, keys: str, columns: list[str], decide: str,
             first: str, accepted: str = "true", extra: str = "", more: str = "") -> None:
    """Recursive walk per key; ``l`` is the state, ``b`` the row looked at.

    State columns are prefixed ``s_``; ``s_t`` is NULL while nothing was accepted.
    """
    state = ", ".join(f"CASE WHEN {accepted} THEN {c} END AS s_{c}" for c in columns)
    hold = ", ".join(
        f"CASE WHEN q.event IS NOT NULL AND ({accepted.replace('tx_ok', 'b.tx_ok')}) "
        f"THEN b.{c} ELSE l.s_{c} END" for c in columns)
    on = " AND ".join(f"b.{k} = l.{k}" for k in keys.split(", "))
    out = f"event_id, {keys}, tx_ok" if "tx_ok" in accepted else f"event_id, {keys}"
    b_out = ", ".join(f"b.{c}" for c in out.split(", "))
    oracle(name, f"SELECT {out}, {extra} event AS event_type, prev_t_us{more} FROM walk "
           "WHERE event IS NOT NULL",
           E_READ, f"""base AS (SELECT *, row_number() OVER (PARTITION BY {keys}
  ORDER BY t_us, event_id) AS n FROM ({rows}) AS src),
walk AS (SELECT n, {out}, {extra} '{first}' AS event, NULL::BIGINT AS prev_t_us, {state}
 FROM base WHERE n = 1
 UNION ALL
 SELECT b.n, {b_out}, {extra and 'b.' + extra} q.event, l.s_t_us, {hold}
 FROM walk AS l JOIN base AS b ON {on} AND b.n = l.n + 1,
 LATERAL (SELECT {decide} AS event) AS q)""", recursive=True)


E_READ = R
_flagged = "SELECT *, CASE WHEN event_id % 16 <> 0 THEN 1 END AS flag FROM r"


def _moved(c: str, delta: float) -> str:
    return (f"((b.{c} IS NULL) <> (l.s_{c} IS NULL) OR ((b.{c} = 0) <> (l.s_{c} = 0)) "
            f"OR abs(b.{c} - l.s_{c}) >= {delta})")


def _since(seconds: float) -> str:
    return f"b.t_us - l.s_t_us >= {int(seconds * 1_000_000)}"


_band = (f"CASE WHEN l.s_t_us IS NULL OR "
         + " OR ".join(f"coalesce({_moved(c, d)}, false)" for c, d in j.BAND.deltas.items())
         + f" THEN 'DELTA_UPDATE' WHEN {_since(j.BAND.heartbeat_s)} THEN 'HEARTBEAT' END")
_band_cols = ["t_us", *j.BAND.deltas]
for _name in ("deadband_generic", "streaming_deadband"):
    fold_sql(_name, _flagged, "session_id, device_id", _band_cols, _band, "DELTA_UPDATE")
fold_sql("commit_on_success", _flagged, "session_id, device_id", _band_cols, _band,
         "DELTA_UPDATE", accepted="tx_ok", extra="t_us, ",
         more=", (row_number() OVER (PARTITION BY session_id ORDER BY t_us, event_id) - 1)"
              " % 65536 AS seq")
fold_sql("heartbeat", "SELECT * FROM r", "session_id, device_id", ["t_us"],
         f"CASE WHEN {_since(j.BEAT_S)} THEN 'HEARTBEAT' END", "SAMPLE")
oracle("streaming_heartbeat", f"""
SELECT b.session_id, b.sent_us, b.event_type, b.t_us, last(x.event_id ORDER BY x.event_id) AS event_id
FROM (SELECT session_id, sent_us, CASE sent_us WHEN lo THEN 'SAMPLE' ELSE 'HEARTBEAT' END AS event_type,
  (SELECT max(t_us) FROM heard AS h WHERE h.session_id = s.session_id AND h.t_us <= sent_us) AS t_us
 FROM (SELECT session_id, lo, unnest(range(lo, hi + 1, {j.BEAT_S * 1_000_000})) AS sent_us
  FROM (SELECT session_id, min(t_us) AS lo FROM heard GROUP BY 1) AS l,
   (SELECT max(t_us) AS hi FROM heard) AS m) AS s) AS b
JOIN heard AS x ON x.session_id = b.session_id AND x.t_us = b.t_us
GROUP BY b.session_id, b.sent_us, b.event_type, b.t_us""", R,
       "heard AS (SELECT * FROM r WHERE session_id <> 3 OR event_id % 5 = 0)")
_ranked = (
    "CASE WHEN l.s_t_us IS NULL THEN 'SAMPLE' "
    "WHEN b.alarm <> l.s_alarm AND b.alarm <> 0 THEN 'ALARM' "
    "WHEN round_even(b.charge, 0) <> round_even(l.s_charge, 0) THEN 'THRESHOLD_CROSSING' "
    f"WHEN abs(b.voltage_mv - l.s_voltage_mv) >= {j.SHUNT.voltage_mv} "
    f"OR abs(b.current_ma - l.s_current_ma) >= {j.SHUNT.current_ma} "
    f"OR abs(b.power_w - l.s_power_w) >= {j.SHUNT.power_w} THEN 'DELTA_UPDATE' "
    f"WHEN {_since(j.SHUNT.heartbeat_s)} THEN 'HEARTBEAT' END")
fold_sql("classify_bmv",
         "SELECT *, floor(charge_state / 40) + charge_state / 1000 AS charge FROM r",
         "session_id, device_id",
         ["t_us", "alarm", "charge", "voltage_mv", "current_ma", "power_w"], _ranked, "SAMPLE")


def spacing_sql(name: str, rows: str, keys: str, seconds: float, shown: str, *ctes: str) -> None:
    on = " AND ".join(f"b.{k} = l.{k}" for k in keys.split(", "))
    b_shown = ", ".join(f"b.{c}" for c in shown.split(", "))
    oracle(name, f"SELECT {shown}, prev_t_us FROM walk WHERE kept", *ctes,
           f"""base AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY t_us, event_id)
  AS n FROM ({rows}) AS src),
walk AS (SELECT n, {shown}, true AS kept, NULL::BIGINT AS prev_t_us, t_us AS s_t_us
 FROM base WHERE n = 1
 UNION ALL
 SELECT b.n, {b_shown}, {_since(seconds)}, l.s_t_us,
  CASE WHEN {_since(seconds)} THEN b.t_us ELSE l.s_t_us END
 FROM walk AS l JOIN base AS b ON {on} AND b.n = l.n + 1)""", recursive=True)


spacing_sql("status_throttle", f"SELECT * FROM f1 WHERE {_mapped} AND {_sound} AND packet_id = 1",
            "session_id, can_id", j.STATUS_S, "event_id, session_id, can_id", BUS)
spacing_sql("rate_limited_warnings", f"""SELECT k, k % 8 AS session_id, k * 60000000 AS t_us,
 k * 4 + unnest(range(len(v))) AS event_id, unnest(v) AS rule FROM (
 SELECT k, {_violations} AS v FROM bat) AS x""",
            "session_id", j.WARNING_S, "k, session_id, rule", POLLS, BATTERY)

# ------------------------------------------------------------------ sinks

_iso = "strftime(make_timestamp({us}), '%Y-%m-%dT%H:%M:%S') || '+00:00'"
CSV_ROWS = f"""starts AS (SELECT session_id, min(t_us) AS s FROM r
 WHERE current_ma::DOUBLE / 1000 < -{j.DRIVE_A} GROUP BY 1),
csv AS (SELECT {_iso.format(us='t_us')} AS timestamp, device_id::VARCHAR AS device_id,
 voltage_mv::VARCHAR AS voltage_mv, current_ma::VARCHAR AS current_ma,
 power_w::VARCHAR AS power_w,
 CASE WHEN event_id % 3 <> 0 THEN ((c * 3) % 1001 // 10) || '.' || ((c * 3) % 1001 % 10) END
  AS charge_state, alarm::VARCHAR AS alarm,
 greatest(coalesce(floor((t_us - s) / 1e6), 0), 0)::BIGINT::VARCHAR AS elapsed_s
 FROM r LEFT JOIN starts USING (session_id))"""


def _device_rows(kind: str, given: dict[str, str]) -> str:
    columns = dim.DEVICE_CSV_COLUMNS[kind]
    return f"SELECT '{kind}' AS device_type, timestamp, device_id, " + ", ".join(
        f"{given.get(c, c) if c in columns else 'NULL'} AS {c}" for c in j.DEVICE_FIELDS)


_numbers = {c: f"{c}::DOUBLE" for c in dim.DEVICE_CSV_COLUMNS["bmv"]}
_pack = {f"cell_{n:02d}_mv": f"string_split(cells, ',')[{n}]::DOUBLE" for n in range(1, 17)}
_pack |= {f"reg_{r}": f"regexp_extract(';' || unidentified, ';{r}=([0-9]+)', 1)::DOUBLE"
          for r in dim.UNIDENTIFIED_REGISTERS}
_at = _iso.format(us="t_us") + " AS timestamp"
oracle("sink_device_csv", f"""
{_device_rows('bmv', _numbers)} FROM csv
UNION ALL {_device_rows('mppt', {})} FROM (SELECT n.*, {_at} FROM ({ORACLES['normalize_mppt']}) AS n
 JOIN e USING (event_id) WHERE reject_reason IS NULL) AS a
UNION ALL {_device_rows('bms', _pack | {'elapsed_s': 'NULL'})} FROM (
 SELECT n.*, k % 8 AS device_id, {_iso.format(us='(k * 60000000)')} AS timestamp
 FROM ({ORACLES['normalize_bms']}) AS n WHERE reject_reason IS NULL) AS b
UNION ALL {_device_rows('rtd', {'fault_name': "nullif(fault_name, '')"})} FROM (SELECT n.*, e.device_id, {_at}
 FROM ({ORACLES['normalize_rtd']}) AS n JOIN e USING (event_id)) AS c""", R, CSV_ROWS)
oracle("sink_schema_rotation", """
SELECT CASE alarm WHEN '0' THEN 'old' ELSE 'new' END AS layout, timestamp, device_id, voltage_mv,
 CASE WHEN alarm <> '0' THEN alarm END AS alarm FROM csv""", R, CSV_ROWS)

_csv_text = {
    "received_at": _iso.format(us="received_us"),
    "packet_timestamp": _iso.format(us="packet_ts * 1000000"),
}


def _double_text(c: str) -> str:
    """The JVM's text of a double with at most four decimals and a small magnitude."""
    tiny = f"abs({c}) < 0.001 AND {c} <> 0"
    digits = f"(round_even(abs({c}) * 1e4, 0)::BIGINT)"
    plain = _plain.format(c=c)
    big = f"abs({c}) >= 1e7"
    return (f"CASE WHEN {tiny} THEN (CASE WHEN {c} < 0 THEN '-' ELSE '' END) || {digits} "
            f"|| '.0E-4' WHEN {big} THEN '?' ELSE {plain} END")


_rows = [(_csv_text[c] if c in _csv_text else
          c if c in ("msg_type", "event_type") else
          f"{c}::BIGINT::VARCHAR" if c in ("device_id", "seq") else _double_text(c)) + f" AS {c}"
         for c in event_csv_columns()]
oracle("sink_event_csv", f"SELECT {', '.join(_rows)} FROM d", *PACKET_CTES)
oracle("sink_routed", f"""
SELECT event_id, msg_type, {_bucket} AS bucket FROM (
 SELECT event_id, msg_type FROM d UNION ALL SELECT event_id, 'ASCII' FROM texts) AS x""",
       *PACKET_CTES, TEXTS)



def _point_number(c: str) -> str:
    return (f"CASE WHEN {c} = round_even({c}, 0) THEN {c}::BIGINT || '.0' "
            f"ELSE {_plain.format(c=c)} END")


def _point_text(t: str) -> str:
    fields = [("event_type", EVENT_CODE), ("field_mask", "field_mask"),
              *[(f"fields_{c}", c) for c in sorted(decoded_columns(t))],
              ("seq", "seq"), ("timestamp", "packet_ts"), ("version", "version")]
    return "concat_ws(',', " + ", ".join(
        f"CASE WHEN ({c}) IS NOT NULL THEN '{n}=' || ({_point_number(f'({c})::DOUBLE')}) END"
        for n, c in fields) + ")"


oracle("sink_line_protocol", f"""
SELECT 'telemetry,device_id=' || device_id || ',msg_type=' || msg_type || ',source=receiver '
 || {_case(lambda t, _: _point_text(t))} || ' ' || (received_us * 1000) AS value FROM d
UNION ALL
SELECT 'telemetry,msg_type=ASCII,source=receiver ' || CASE event_id % 2 WHEN 0 THEN 'received=1.0'
 ELSE 'temp=' || c || '.0' END || ',payload="' || text || '" ' || (received_us * 1000)
FROM texts""", *PACKET_CTES, TEXTS)

oracle("fan_out", """
SELECT sink, sink <> 'broken' AS ok, CASE sink WHEN 'broken' THEN 'ValueError' END AS error,
 CASE WHEN sink <> 'broken' THEN n END AS n_rows, CASE WHEN sink <> 'broken' THEN s END AS id_sum
FROM (SELECT unnest(['parquet', 'broken', 'routed']) AS sink, n, s FROM (
 SELECT count(*) AS n, sum(event_id) AS s FROM (
  SELECT event_id FROM d UNION ALL SELECT event_id FROM texts) AS x) AS y) AS z""",
       *PACKET_CTES, TEXTS)

# ------------------------------------------------------------------ hot keys

for _name in j.CUT:
    ORACLES[f"{_name}_cut"] = ORACLES[_name]
