"""SQL fragments shared by several oracles: labels, classification, location category."""

from __future__ import annotations

from gate.surrogates import quoted
from tidemark import rules


def labels(rule_list, text: str) -> str:
    cases = ", ".join(
        f"CASE WHEN regexp_matches({text}, {quoted('(?i)' + r.regex)}) THEN {quoted(r.label)} END" for r in rule_list
    )
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


def classified(source: str, name: str = "classified") -> str:
    """CTE adding flags, score, labels and reason to rows with title, level, description_text."""
    return f"""{name} AS (
  SELECT *, NOT vetoed AND len(sw) > 0 AS is_swe, entry_level_score > 0 AS is_entry,
    CASE WHEN vetoed THEN 'non_software_role_in_title' WHEN len(sw) = 0 THEN 'no_software_engineering_indicators'
      WHEN entry_level_score <= 0 THEN 'not_entry_level' END AS reason
  FROM (SELECT *, CAST(len(pos_l) AS DOUBLE) * 2 - CAST(len(neg_l) AS DOUBLE) * 3 AS entry_level_score,
      len(non_l) > 0 AND len(exp_l) = 0 AS vetoed,
      CASE WHEN len(non_l) > 0 AND len(exp_l) = 0 THEN [] WHEN len(title_l) > 0 THEN title_l ELSE full_l END AS sw
    FROM (SELECT *, {labels(rules.ENTRY_POSITIVE, 'full_text')} AS pos_l, {labels(rules.ENTRY_NEGATIVE, 'full_text')} AS neg_l,
        {labels(rules.NON_SOFTWARE, 'title')} AS non_l, {labels(rules.EXPLICIT_SOFTWARE_TITLE, 'title')} AS exp_l,
        {labels(rules.SOFTWARE, 'title')} AS title_l, {labels(rules.SOFTWARE, 'full_text')} AS full_l
      FROM (SELECT *, concat_ws(chr(10), title, nullif(level, ''), nullif(description_text, '')) AS full_text FROM {source}))))"""


def _has(pattern: str) -> str:
    return f"regexp_matches(seg, {quoted('(?i)' + pattern)})"


_STATES = ", ".join(quoted(s) for s in rules.HOME_STATES)
# loc_cat(location, category): one row per distinct location of `source`
def location_categories(source: str) -> str:
    return f"""locs AS (SELECT DISTINCT location, trim(regexp_replace(lower(coalesce(location, '')), '\\s+', ' ', 'g')) AS norm FROM {source}),
segs AS (SELECT location, norm, trim(unnest(string_split_regex(norm, {quoted('(?i)' + rules.LOCATION_SPLIT)}))) AS seg FROM locs),
kept AS (SELECT location, seg FROM segs WHERE seg <> ''
  UNION ALL SELECT location, norm FROM locs WHERE norm NOT IN (SELECT norm FROM segs WHERE seg <> '')),
toks AS (SELECT location, seg, tok, lag(tok) OVER (PARTITION BY location, seg ORDER BY i) AS prev
  FROM (SELECT location, seg, unnest(t) AS tok, generate_subscripts(t, 1) AS i
    FROM (SELECT DISTINCT location, seg, string_split(trim(regexp_replace(seg, '[\\s,]+', ' ', 'g')), ' ') AS t FROM kept))),
token_hits AS (SELECT DISTINCT seg FROM toks
  WHERE regexp_replace(tok, '[^a-z]', '', 'g') IN ({_STATES}) AND coalesce(prev, '') NOT IN ('in', 'of')),
seg_cat AS (SELECT location, CASE WHEN seg = '' THEN 'UNKNOWN'
    WHEN {_has(rules.REMOTE_ABROAD)} OR {_has(rules.ABROAD)} THEN 'INTERNATIONAL'
    WHEN {_has(rules.REMOTE_HOME)} OR {_has(rules.REMOTE_PREFIX)} THEN 'REMOTE_US'
    WHEN {_has(rules.HOME_COUNTRY)} OR {_has(rules.HOME_STATE_NAMES)} OR seg IN (SELECT seg FROM token_hits)
      OR regexp_matches(seg, ',\\s*({'|'.join(rules.HOME_STATES)})\\b') THEN 'US'
    WHEN {_has(rules.HOME_CITIES)} THEN 'US' WHEN {_has(rules.REMOTE_WORD)} THEN 'REMOTE_US' ELSE 'UNKNOWN' END AS c FROM kept),
loc_cat AS (SELECT location, CASE WHEN bool_or(c = 'INTERNATIONAL') THEN 'INTERNATIONAL' WHEN bool_or(c = 'UNKNOWN') THEN 'UNKNOWN'
    WHEN bool_or(c = 'US') THEN 'US' ELSE 'REMOTE_US' END AS category FROM seg_cat GROUP BY location)"""
