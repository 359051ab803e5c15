"""DuckDB forms of the demo relations."""

OBS = """
ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
obs AS (SELECT event_id, user_id, 'run-' || strftime(ts, '%Y%m%d') AS run_id, 'u' || user_id AS utterance_id,
  CASE WHEN user_id % 3 = 0 THEN 'hi-IN' ELSE 'en-IN' END AS language, event_type AS condition,
  CASE WHEN k % 10 = 0 THEN 'mock' ELSE 'batch' END AS asr_impl,
  CASE WHEN event_id % 97 <> 0 THEN 'm' || (k % 2) END AS asr_model,
  CASE WHEN (k // 2) % 2 = 0 THEN 'transcribe' ELSE 'verbatim' END AS asr_mode,
  CASE WHEN event_id % 97 = 0 THEN 1.0 ELSE (event_id % 11) / 10.0 END::DOUBLE AS wer,
  CASE WHEN event_id % 97 = 0 THEN 'timeout' END AS error,
  CASE WHEN user_id % 2 = 0 THEN 'digits' ELSE 'words' END AS realization, 't' || (user_id % 7) AS template_id,
  sha256(CASE WHEN user_id % 7 <> 0 THEN user_id || '|' || event_type ELSE user_id::VARCHAR END) AS audio_sha256, value
  FROM ev)"""

ROWS = OBS + """,
rows_ AS (SELECT * FROM obs WHERE asr_impl <> 'mock'
  QUALIFY row_number() OVER (PARTITION BY utterance_id, condition, coalesce(asr_model, '-'), coalesce(asr_mode, '-') ORDER BY run_id DESC, event_id) = 1),
gold AS (SELECT r.*, p.pos, CASE WHEN p.pos = 0 THEN 'otp' ELSE ['account_number', 'pin_code', 'currency', 'date'][user_id % 4 + 1] END AS type,
  CASE WHEN p.pos = 0 THEN lpad((user_id * 7919 % 1000000)::VARCHAR, 6, '0')
    WHEN user_id % 4 = 0 THEN '1' || lpad((user_id * 1000003 % 10000000000)::VARCHAR, 10, '0')
    WHEN user_id % 4 = 1 THEN (100000 + user_id * 37 % 900000)::VARCHAR
    WHEN user_id % 4 = 2 THEN 'INR:' || (user_id * 131 + 100) || '.00'
    ELSE '2026-' || lpad((1 + user_id % 12)::VARCHAR, 2, '0') || '-' || lpad((1 + user_id % 28)::VARCHAR, 2, '0') END AS expected,
  (value < 60 AND (event_id + p.pos) % 3 <> 0 AND event_id % 97 <> 0) AS hit
  FROM rows_ r, (VALUES (0), (1)) p(pos)),
ents AS (SELECT *, CASE WHEN NOT hit AND event_id % 5 <> 0 AND event_id % 97 <> 0
    THEN left(expected, length(expected) - 1) || ((right(expected, 1)::INTEGER + 1) % 10) END AS found FROM gold),
prim AS (SELECT * FROM rows_ WHERE asr_mode = 'transcribe'),
pents AS (SELECT * FROM ents WHERE asr_mode = 'transcribe')"""

SAID = """,
said AS (SELECT *, coalesce(CASE WHEN hit THEN CASE WHEN realization = 'words' AND type = 'otp'
    THEN array_to_string(list_transform(string_split(expected, ''), lambda c: ['zero','one','two','three','four','five','six','seven','eight','nine'][c::INTEGER + 1]), ' ')
    ELSE expected END ELSE found END, '') AS s FROM ents),
hyps AS (SELECT event_id, CASE WHEN max(error) IS NOT NULL THEN '' ELSE trim('code ' || max(CASE WHEN pos = 0 THEN s END) || ' value ' || max(CASE WHEN pos = 1 THEN s END)) END AS hypothesis
  FROM said GROUP BY event_id)"""
