"""SQL that says what the queries of the registry return, over the same tables."""

from __future__ import annotations

from ..functions import fixed
from .fixtures import BOXES_SQL, GOVERNED_SQL, META_SQL


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _case(code: str, words: dict[str, str], default: str | None) -> str:
    return "case " + code + "".join(f" when {_text(k)} then {_text(v)}" for k, v in words.items()) + (f" else {_text(default)}" if default is not None else "") + " end"


def _band(volume: str, names: tuple[str, ...]) -> str:
    return "case " + " ".join(f"when {volume} < {b} then {_text(n)}" for b, n in zip(fixed.BANDS, names, strict=False)) + f" else {_text(names[-1])} end"


def _clause(volume: str) -> str:
    brand = _case("brand", fixed.BRAND_WORDS, None)
    return f"{_text(fixed.EDIT_SENTENCE)} || {volume} || ' cc ' || {_case('shape', fixed.SHAPE_WORDS, fixed.DEFAULT_SHAPE_WORDS)} || ', using ' || {_case('profile', fixed.PROFILE_WORDS, fixed.DEFAULT_PROFILE_WORDS)} || coalesce(', in the style of ' || {brand}, '') || '.'"


_CAPTION = f"{_clause('volume_cc')} || ' The change should read as ' || {_band('volume_cc', fixed.BAND_PHRASES)} || '. ' || {_text(fixed.KEEP_SENTENCE)}"
_CLAMPED = "least(800, greatest(150, volume_cc))"
_PROMPT = " || chr(10) || ".join([_text(fixed.PROMPT_HEAD), _clause(_CLAMPED), f"'The change should read as ' || {_band(_CLAMPED, fixed.BAND_PHRASES)} || {_text(fixed.PROMPT_BAND_TAIL)}", *map(_text, fixed.PROMPT_RULES)])

_ERRORS = f"""{META_SQL},
listed as (select *, case when k % 31 = 0 then ['meta.json is not valid JSON'] else list_filter([
  case when shape is null or shape = '' then 'missing required field ''shape''' end,
  case when consent_ref is null or consent_ref = '' then 'missing required field ''consent_ref''' end,
  case when shape not in ('round', 'teardrop') then 'invalid shape ''' || shape || '''' end,
  case when view not in ('front', 'oblique-left', 'oblique-right', 'side-left', 'side-right') then 'invalid view ''' || view || '''' end,
  case when volume_cc not between 100 and 1000 then 'volume_cc must be an integer between 100 and 1000, got ' || volume_cc end,
  case when pair_id <> folder then 'pair_id ''' || pair_id || ''' does not match folder name ''' || folder || '''' end,
  case when before is null then 'no before.(jpg|png|webp) image' end,
  case when after is null then 'no after.(jpg|png|webp) image' end], lambda x: x is not null) end as errors from meta)"""

_STRICT = _ERRORS.replace("  case when before is null", """  case when k % 4 = 3 then 'clothing is not in its domain' end,
  case when k % 9 = 0 then 'months_post_op must be a number of at least 0' end,
  case when before is null""")

_SPLIT = "case when row_number() over (order by md5('42:' || pair_id), pair_id) <= case when count(*) over () > 1 then greatest(1, cast(floor(count(*) over () * 0.1) as bigint)) else 0 end then 'val' else 'train' end as split"

_REASONS = f"""{BOXES_SQL},
reasons as (select k || '/' || n as label, 'ingest' as stage, coalesce(
  case when least(width, height) < 512 then 'before image too small (' || width || 'x' || height || ')' end,
  case when least(height, w * 10) < 512 then 'after image too small (' || height || 'x' || w * 10 || ')' end,
  case when faces = 3 then 'after is a duplicate' end) as reason from boxes)"""

_ASPECT_ROWS = ", ".join(f"({i}, {_text(name)}, {a}::double / {b}::double)" for i, (name, (a, b)) in enumerate((n, n.split(":")) for n, _ in fixed.ASPECTS))
_ASPECTS = f"""{BOXES_SQL}, ratios(i, name, r) as (values {_ASPECT_ROWS}),
sizes as (select distinct width, height from boxes where width > 0 and height > 0),
best as (select width, height, name from (select *, row_number() over (partition by width, height order by abs(ln(width::double / height::double / r)), i) as p from sizes, ratios) where p = 1)"""

_HITS = "hits as (select event_type as key, cast(floor(epoch_us(ts) / 1000000) as bigint) as t, event_id as id from events)"
_MIME = "['image/jpeg', 'image/png', 'image/webp', 'image/gif'][k % 4 + 1]"
_SAY = {k: _text(v) for k, v in fixed.SAYS.items()}

_CATALOGUE = (
    ("brand", fixed.BRANDS, ((1, "name"), (2, "manufacturer"), (3, "fill"), (4, "blurb"))),
    ("profile", fixed.PROFILES, ((1, "name"), (2, "blurb"))),
    ("shape", fixed.SHAPE_ROWS, ((1, "name"), (2, "blurb"))),
)
_GUARDS = """c as (select *, case when k % 10 = 0 then 'rate' when k % 8 in (0, 1, 2) then 'large' when k % 12 = 0 then 'json' when k % 7 = 0 then 'photo' when k % 4 = 3 then 'mime'
  when brand in ('other', 'unknown') or shape not in ('round', 'teardrop') or profile = 'unknown' or volume_cc not between 150 and 800 then 'config' else 'demo' end as g from meta)"""

_OWNER = "list_filter(s.seen, lambda q: q.d = e.{0})[1].o"
_B_NEW, _A_NEW = f"e.b_bad is null and {_OWNER.format('b')} is null", f"e.a_bad is null and e.a <> e.b and {_OWNER.format('a')} is null"
#: Every pair of the raw folders with the stage and reason that stop it; null if none does.
_INGESTED = f"""{_ERRORS},
named as (select *, clinic || '/' || folder as label, 8 + k % 10 as w, 9 + k % 3 as h, 9 + k % 4 as w2, 8 + k % 8 as h2, {GOVERNED_SQL} as governed from listed),
usable as (select *, case when k % 37 = 0 then 'cannot read before' when least(w, h) < 9 then 'before image too small (' || w || 'x' || h || ')' end as b_bad,
  case when least(w2, h2) < 9 then 'after image too small (' || w2 || 'x' || h2 || ')' end as a_bad,
  (w * h) || '-' || (k % 31) || '-' || (k % 4 <> 0) as b, (w2 * h2) || '-' || ((k * 7 + 3) % 31) || '-' || (k % 6 <> 0) as a
  from named where len(errors) = 0 and governed),
inorder as (select list({{label: label, b: b, a: a, b_bad: b_bad, a_bad: a_bad}} order by clinic, folder) as x from usable),
told as (select unnest(r.out) as u from (select list_reduce(x, lambda s, e: {{
    seen: case when {_B_NEW} then case when {_A_NEW} then list_append(list_append(s.seen, {{d: e.b, o: e.label || '/before'}}), {{d: e.a, o: e.label || '/after'}}) else list_append(s.seen, {{d: e.b, o: e.label || '/before'}}) end else s.seen end,
    out: list_append(s.out, {{label: e.label, reason: coalesce(e.b_bad, 'before is a duplicate of ' || {_OWNER.format('b')}, e.a_bad, case when e.a = e.b then 'after is a duplicate of ' || e.label || '/before' end, 'after is a duplicate of ' || {_OWNER.format('a')})}})}},
  {{seen: []::struct(d varchar, o varchar)[], out: []::struct(label varchar, reason varchar)[]}}) as r from inorder)),
ingested as (select k, label, case when len(errors) > 0 then 'validate' when not governed then 'consent' else 'images' end as stage,
  case when len(errors) > 0 then array_to_string(errors, '; ') when not governed then 'no active consent of an attested adult' else (select u.reason from told where u.label = named.label) end as reason from named)"""
_CLEANED = f"""{_INGESTED}, cleaned as (select label, case when k % 4 = 0 then 'no face detected in before' when k % 6 = 0 then 'no face detected in after' end as reason from ingested where reason is null)"""

ORACLE_SQL: dict[str, str] = {
    "validate_errors": f"with {_ERRORS} select k, array_to_string(errors, '; ') as errors, cast(len(errors) as bigint) as n_errors, len(errors) = 0 as accepted from listed",
    "schema_errors": f"with {_STRICT} select k, array_to_string(errors, '; ') as errors from listed",
    "accept_reject_counts": f"with {_ERRORS} select cast(count(*) filter (len(errors) = 0) as bigint) as accepted, cast(count(*) filter (len(errors) > 0) as bigint) as rejected from listed",
    "consent_gate": f"with {META_SQL} select k, consent_ref from meta where consent_ref <> ''",
    "reject_reasons": f"with {_REASONS} select * from reasons where reason is not null",
    "reject_totals": f"with {_REASONS} select stage, split_part(reason, ' ', 1) as stem, count(*) as n from reasons where reason is not null group by 1, 2",
    "captions": f"with {META_SQL} select k, {_CAPTION} as caption from meta",
    "edit_prompts": f"with {META_SQL} select k, {_PROMPT} as prompt from meta",
    "volume_bands": f"with {META_SQL} select k, {_band('volume_cc', fixed.BAND_PHRASES)} as phrase, {_band('volume_cc', fixed.BAND_LABELS)} as label, cast({_CLAMPED} as bigint) as clamped from meta",
    "catalog_lookup": f"with {META_SQL} select k, " + ", ".join(f"{_case(code, {r[0]: r[i] for r in rows}, None)} as found_{code}_{name}" for code, rows, names in _CATALOGUE for i, name in names) + " from meta",
    "catalog_unknown": f"with {META_SQL} select k, brand from meta where brand in ('other', 'unknown')",
    "catalog_unnest": "select * from (values " + ", ".join(f"({_text(b[0])}, cast({i} as bigint), {_text(h)})" for b in fixed.BRANDS for i, h in enumerate(b[5])) + ") as t(brand_id, position, highlight)",
    "split_assign": f"with {META_SQL} select pair_id, {_SPLIT} from meta",
    "split_counts": f"with {META_SQL}, s as (select {_SPLIT} from meta) select count(*) filter (split = 'train') as n_train, count(*) filter (split = 'val') as n_val, count(*) filter (split = 'train') < 500 as too_small from s",
    "manifest": f"with {_ERRORS}, s as (select pair_id, {_CAPTION} as instruction, {_SPLIT} from listed where len(errors) = 0) select pair_id, split, split || '/control/' || pair_id || '.jpg' as control, split || '/target/' || pair_id || '.jpg' as target, instruction from s",
    "pixel_hash_text": "select doc_id, sha256(text) as digest from documents",
    "dedupe_greedy": """with s as (select doc_id - doc_id % 2 as ord, max(case when doc_id % 2 = 0 then sha256(text) end) as before, max(case when doc_id % 2 = 1 then sha256(text) end) as after from documents group by 1),
p as (select *, ord % 26 <> 0 as b_ok, ord % 34 <> 0 as a_ok from s where before is not null and after is not null),
l as (select list({o: ord, b: before, a: after, b_ok: b_ok, a_ok: a_ok} order by ord) as x from p),
f as (select list_reduce(x, lambda s, e: {
    seen: case when e.b_ok and not list_contains(s.seen, e.b) then case when e.a_ok and e.a <> e.b and not list_contains(s.seen, e.a) then list_append(list_append(s.seen, e.b), e.a) else list_append(s.seen, e.b) end else s.seen end,
    o: list_append(s.o, {ord: e.o, accepted: e.b_ok and not list_contains(s.seen, e.b) and e.a_ok and e.a <> e.b and not list_contains(s.seen, e.a)})},
  {seen: []::varchar[], o: []::struct(ord bigint, accepted boolean)[]}) as r from l)
select u.ord, u.accepted from (select unnest(r.o) as u from f)""",
    "pair_assemble": """with f as (select cast(floor(doc_id / 2) as bigint) as folder, max(case when doc_id % 2 = 0 and doc_id % 13 <> 0 then cast(doc_id as varchar) end) as before, max(case when doc_id % 2 = 1 and doc_id % 13 <> 0 then cast(doc_id as varchar) end) as after from documents group by 1)
select *, concat_ws('; ', case when before is null then 'no before.(jpg|png|webp) image' end, case when after is null then 'no after.(jpg|png|webp) image' end) as errors from f""",
    "best_extension": """with f as (select cast(floor(page_id / 3) as bigint) as folder, ['webp', 'png', 'JPG', 'jpeg', 'jpg'][cast((page_id * 7 + floor(page_id / 5)) as bigint) % 5 + 1] as e from pages)
select folder, 'before.' || arg_min(e, list_position(['jpg', 'jpeg', 'png', 'webp'], e)) as path from f where e <> 'JPG' group by 1""",
    "path_order": f"with {META_SQL} select k, row_number() over (order by clinic, folder) - 1 as ord from meta",
    "rate_limit": f"""with {_HITS}, l as (select key, list({{t: t, id: id}} order by t, id) as x from hits group by 1),
f as (select key, list_reduce(x, lambda s, e: {{
    kept: case when len(list_filter(s.kept, lambda q: e.t - q < 7200)) >= 8 then list_filter(s.kept, lambda q: e.t - q < 7200) else list_append(list_filter(s.kept, lambda q: e.t - q < 7200), e.t) end,
    o: list_append(s.o, {{t: e.t, id: e.id, blocked: len(list_filter(s.kept, lambda q: e.t - q < 7200)) >= 8}})}},
  {{kept: []::bigint[], o: []::struct(t bigint, id bigint, blocked boolean)[]}}) as r from l)
select key, u.t, u.id, u.blocked from (select key, unnest(r.o) as u from f)""",
    "client_key": "select event_id, coalesce(nullif(trim(split_part(case event_id % 6 when 0 then null when 1 then ' , 10.0.0.1' when 2 then '  ' || user_id || ' ,x' else cast(user_id as varchar) end, ',', 1)), ''), 'unknown') as client from events",
    "latest_wins": "select conv_id, turn, turn = max(turn) over (partition by conv_id) as kept from conversations",
    "can_generate": "select conv_id, turn, turn % 2 = 0 and conv_id % 3 <> 0 and turn % 5 <> 0 as enabled from conversations",
    "closest_aspect": f"with {_ASPECTS} select k, n, name as aspect from boxes left join best using (width, height)",
    "scale_dims": f"with {BOXES_SQL} select k, n, cast(floor(width * least(1.0::double, 1536.0::double / greatest(width, height)) + 0.5) as bigint) as width, cast(floor(height * least(1.0::double, 1536.0::double / greatest(width, height)) + 0.5) as bigint) as height, least(boxes.width, boxes.height) >= 512 as large from boxes",
    "bbox_expand": f"""with {BOXES_SQL}, m as (select *, cast(trunc(w * 0.35::double) as bigint) as mx, cast(trunc(h * 0.35::double) as bigint) as my from boxes),
e as (select k, n, cast(greatest(0, x - mx) as bigint) as x0, cast(greatest(0, y - my) as bigint) as y0, cast(least(width, x + w + mx) as bigint) as x1, cast(least(height, y + h + my) as bigint) as y1 from m)
select k, n, case when x1 > x0 and y1 > y0 then x0 end as x0, case when x1 > x0 and y1 > y0 then y0 end as y0, case when x1 > x0 and y1 > y0 then x1 end as x1, case when x1 > x0 and y1 > y0 then y1 end as y1 from e""",
    "crop_rows": f"with {BOXES_SQL} select k, n, cast(trunc(height * 0.2::double) as bigint) as first, height - cast(trunc(height * 0.2::double) as bigint) as kept from boxes",
    "noface_gate": f"with {BOXES_SQL} select k, n, faces = 0 and not (allow or crop <> 0) as parity, faces = 0 and not allow as strict from boxes",
    "guard_cascade": f"""with {META_SQL},
c as (select k, case when k % 10 = 0 then 'rate' when k % 8 in (0, 1, 2) then 'large' when k % 12 = 0 then 'json' when k % 7 = 0 then 'photo' when k % 4 = 3 then 'mime'
  when brand in ('other', 'unknown') or shape not in ('round', 'teardrop') or profile = 'unknown' or volume_cc not between 150 and 800 then 'config' else 'demo' end as g from meta)
select k, cast(case g when 'rate' then 429 when 'large' then 413 when 'demo' then 200 else 400 end as bigint) as status, case when g = 'demo' then true end as demo,
  case when g = 'demo' then 'aGk' || k end as image, case g {" ".join(f"when {_text(x)} then {_SAY[x]}" for x in ("rate", "large", "json", "photo", "mime", "config", "demo"))} end as said from c""",
    "response_map": f"""with g as (select conv_id as c, min(case when role = 'assistant' and conv_id % 4 <> 0 and conv_id % 3 <> 0 then turn end) as t from conversations group by 1),
s as (select c, case when c % 16 <> 0 then t end as t, (c % 16 <> 0 and c % 5 in (0, 1)) or c % 7 = 0 as blocked,
  case when c % 21 = 20 then 'timeout' when c % 21 = 19 then 'unreachable' when c % 10 = 9 then 'busy' when c % 10 = 8 then 'failed' end as f from g),
a as (select *, case when f is not null then f when t is not null then 'ok' when blocked then 'declined' else 'no_image' end as r from s)
select c as conv_id, cast(case r when 'ok' then 200 when 'declined' then 422 else 502 end as bigint) as status,
  case r {" ".join(f"when {_text(x)} then {_SAY[x]}" for x in ("timeout", "unreachable", "busy", "failed", "declined", "no_image"))} end as error,
  case when r = 'ok' then 'img' || t end as image, case when r = 'ok' then case when t % 2 = 0 then 'image/jpeg' else 'image/png' end end as mime from a""",
    "request_json": f"""with {_ASPECTS} select k, n, '{{"contents":[{{"parts":[{{"inlineData":{{"mimeType":"image/png","data":"' || k || '"}}}},{{"text":"prompt"}}]}}],"generationConfig":{{"responseModalities":["IMAGE"]' || case when k % 3 <> 0 then ',"imageConfig":{{"aspectRatio":"' || name || '"}}' else '' end || '}}}}' as body from boxes left join best using (width, height)""",
    "file_checks": f"with {BOXES_SQL} select k, n, case when k % 4 = 3 then {_SAY['file_type']} when width * height * 4 > 20971520 then {_SAY['file_size']} end as error from boxes",
    "download_name": f"with {META_SQL} select k, 'preview-' || brand || '-' || shape || '-' || volume_cc || 'cc.' || ['jpg', 'png', 'webp', 'png'][k % 4 + 1] as name, 'data:' || {_MIME} || ';base64,' || k as url from meta",
    "provider_error_detail": "select doc_id, substr(text, 1, 500) as detail, string_split(text, ',')[2] as payload from documents",
    "expired_keys": f"with {_HITS} select id % 997 as key from hits group by 1 having max(t) <= (select max(t) from hits) - 86400",
    "consent_strict": f"with {META_SQL} select k, consent_ref from meta where {GOVERNED_SQL}",
    "content_length": "select event_id, event_id % 14 <> 13 and event_id % 13 in (0, 1, 3, 5, 6, 9) as ok from events",
    "provider_flow": f"""with {META_SQL}, {_GUARDS},
a as (select *, case when g <> 'demo' then g when k % 17 = 0 then 'unreachable' when k % 21 = 20 then 'timeout' when k % 10 = 9 then 'busy' when k % 10 = 7 then 'failed' when k % 3 <> 0 then 'ok' when k % 5 = 0 then 'declined' else 'no_image' end as r from c)
select k, cast(case r when 'rate' then 429 when 'large' then 413 when 'ok' then 200 when 'declined' then 422 else case when g = 'demo' then 502 else 400 end end as bigint) as status, case when r = 'ok' then false end as demo,
  case r {" ".join(f"when {_text(x)} then {_SAY[x]}" for x in ("rate", "large", "json", "photo", "mime", "config", "timeout", "unreachable", "busy", "failed", "declined", "no_image"))} end as error,
  case when r = 'ok' then 'img' || k end as image, case when r = 'ok' then case when k % 2 = 0 then 'image/jpeg' else 'image/png' end end as mime from a""",
    "provider_bodies": f"""with {META_SQL}, {_GUARDS} select k, '{{"contents":[{{"parts":[{{"inlineData":{{"mimeType":"' || {_MIME} || '","data":"aGk' || k || '"}}}},{{"text":"prompt"}}]}}],"generationConfig":{{"responseModalities":["IMAGE"]}}}}' as body from c where g = 'demo'""",
    "response_bodies": f"""with {META_SQL}, {_GUARDS} select k, case when g = 'demo' then '{{"demo":true,"image":"aGk' || k || '","mimeType":"' || {_MIME} || '","message":' || to_json({_SAY["demo"]}) || '}}'
  else '{{"error":' || to_json(case g {" ".join(f"when {_text(x)} then {_SAY[x]}" for x in ("rate", "large", "json", "photo", "mime", "config"))} end) || '}}' end as body from c""",
    "decoded_images": """select p_partkey as k, p_partkey % 13 <> 0 as decodable, case when p_partkey % 13 <> 0 then 2 + p_partkey % 7 else -1 end as width, case when p_partkey % 13 <> 0 then 1 + p_partkey % 5 else -1 end as height,
  case when p_partkey % 13 <> 0 then sha256(repeat(chr(cast(33 + p_partkey % 31 as integer)), cast(3 * (2 + p_partkey % 7) * (1 + p_partkey % 5) as bigint))) end as digest from part""",
    "ingest_flow": f"with {_INGESTED} select label, case when reason is null then null else stage end as stage, reason from ingested",
    "clean_flow": f"with {_CLEANED} select label, cast(case when reason is null then 2 else 0 end as bigint) as faces, reason from cleaned",
    "export_flow": f"""with {_CLEANED}, e as (select meta.* from cleaned join meta on clinic || '/' || folder = label where reason is null and meta.k % 3 <> 0),
s as (select pair_id, {_CAPTION} as instruction, {_SPLIT} from e)
select pair_id, split, split || '/control/' || pair_id || '.jpg' as control, split || '/target/' || pair_id || '.jpg' as target, instruction from s""",
}
