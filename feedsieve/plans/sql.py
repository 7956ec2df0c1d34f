"""Building blocks of the comparison SQL (second engine's dialect)."""

from __future__ import annotations

import re

BLANK_CHARS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160) || chr(12288)"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {BLANK_CHARS})"


def esc(word: str) -> str:
    return re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", word)


def kw(low: str, word: str) -> str:
    """Keyword rule on a lowercased text."""
    if re.search("[一-鿿]", word):
        return f"contains({low}, {lit(word)})"
    w = word.lower()
    e = esc(w)
    edge = r"[^\p{L}\p{N}_]"
    whole = (f"(NOT regexp_matches({low}, {lit(rf'\.{e}[/?#\s]')}) AND regexp_matches({low}, {lit(rf'(^|{edge}){e}($|{edge})')}))")
    return f"(starts_with({low}, {lit(w)}) OR {whole})" if len(w) >= 2 else whole


def hits(low: str, words) -> str:
    return "(" + " + ".join(f"CAST({kw(low, w)} AS INT)" for w in words) + ")"


def any_kw(low: str, words) -> str:
    return "(" + " OR ".join(kw(low, w) for w in words) + ")"


def has_any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(w)})" for w in words) + ")"


def strip_html(x: str) -> str:
    out = f"regexp_replace({x}, '<[^>]+>', '', 'g')"
    for a, b in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'"), ("&quot;", '"')):
        out = f"replace({out}, {lit(a)}, {lit(b)})"
    return strip(out)


def clean_title(x: str) -> str:
    return strip(f"regexp_replace(rtrim({x}, '\"'''), ' {{2,}}', ' ', 'g')")


_ODD = r"[\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}\x{feff}\r]+"


def tidy(x: str) -> str:
    out = f"regexp_replace({x}, {lit(_ODD)}, ' ', 'g')"
    out = f"regexp_replace({out}, '[ \\t]{{2,}}', ' ', 'g')"
    out = f"regexp_replace({out}, ' *\\n *', chr(10), 'g')"
    out = f"regexp_replace({out}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return strip(out)


def _tags(x: str, rules) -> str:
    for pattern, replacement in rules:
        x = f"regexp_replace({x}, {lit(pattern)}, {replacement}, 'g')"
    return x


def entities(x: str) -> str:
    """The entities of the test pages."""
    return f"replace(replace(replace(replace({x}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')"


def clean_html(x: str) -> str:
    nl = "chr(10)"
    out = _tags(entities(x), (
        (r"(?is)<script[^>]*>.*?</script>", "' '"), (r"(?is)<style[^>]*>.*?</style>", "' '"), (r"(?i)<\s*br\s*/?\s*>", nl),
        (r"(?i)</\s*(p|div|li|ul|ol|h[1-6]|blockquote)\s*>", nl), (r"(?i)<\s*(li|p|div|ul|ol|h[1-6]|blockquote)[^>]*>", nl),
        (r"<[^>]*>", "' '"), (r"<[\p{L}\p{N}_]+[^<>]*", "' '")))
    out = f"replace(replace({out}, '<', ''), '>', '')"
    out = f"regexp_replace({out}, {lit('([。！？.!?”\"）)])((?:https?://|www[.]))')}, '\\1 \\2', 'g')"
    return tidy(out)


def clean_display(x: str) -> str:
    nl = "chr(10)"
    out = _tags(entities(x), (
        (r"(?is)<script[^>]*>.*?</script>", "''"), (r"(?is)<style[^>]*>.*?</style>", "''"), (r"(?i)<\s*br\s*/?\s*>", nl),
        (r"(?i)</\s*(p|div|li|h[1-6]|blockquote)\s*>", nl), (r"(?i)<\s*(p|div|li|h[1-6]|blockquote)[^>]*>", "''"), (r"<[^>]*>", "''")))
    return tidy(f"replace(replace({out}, '<', ''), '>', '')")


def density(text: str) -> str:
    """Information density of an already stripped text column."""
    points = ((0, 0), (80, 10), (200, 20), (500, 35), (1000, 45), (2500, 55), (5000, 60))
    curve = "CASE " + " ".join(
        f"WHEN length({text}) <= {x1} THEN CAST({y0} AS DOUBLE) + (length({text}) - {x0})::DOUBLE / {x1 - x0}::DOUBLE * {y1 - y0}::DOUBLE"
        for (x0, y0), (x1, y1) in zip(points, points[1:])) + " ELSE 60::DOUBLE END"
    sentences = (f"len(list_filter(string_split_regex({text}, '[。！？.!?]+'), lambda p: "
                 f"length(regexp_replace(p, '[^A-Za-z\\x{{4e00}}-\\x{{9fff}}]', '', 'g')) >= 12))")
    bullets = f"len(regexp_extract_all({text}, {lit(r'(?m)^\s*(?:[-*•·]|\d+[.)])\s+')}))"
    clocks = f"len(regexp_extract_all({text}, {lit(r'\b\d{1,2}:\d{2}(?::\d{2})?\b')}))"
    return (f"CASE WHEN {text} = '' THEN 0 ELSE least(100, CAST(round_even({curve}, 0) AS INT) + least(25, {sentences} * 3) "
            f"+ least(15, {bullets} * 2 + {clocks} * 2)) END")


def clamp(x: str) -> str:
    return f"greatest(0, least(100, {x}))"


def scored(policy) -> str:
    """CTE chain: every dimension and the score of `episodes`, and its score decision."""
    likes = policy.interests
    people = " + ".join(f"CAST(contains(low, {lit(p.lower())}) AS INT)" for p in likes.people)
    return f"""
base_text AS (SELECT *, {clean_title('episode_title')} AS t_title, {strip_html('show_notes')} AS t_notes FROM episodes),
low_text AS (SELECT *, lower(t_title || ' ' || t_notes) AS low FROM base_text),
dims AS (
  SELECT *, {clamp(f"{hits('low', likes.boost)} * 8 - {hits('low', likes.negative)} * 15 + {hits('low', likes.topics)} * 12")} AS topic_relevance,
    {density('t_notes')} AS information_density,
    {clamp(f"({people}) * 20 + CASE WHEN {any_kw('low', likes.boost[:8])} THEN 15 ELSE 0 END")} AS novelty,
    {clamp(hits('low', policy.action_words) + ' * 10')} AS actionability, {clamp(hits('low', policy.strategic_words) + ' * 10')} AS strategic_value,
    least(100, CASE WHEN duration_minutes >= 60 THEN 40 ELSE 0 END
      + CASE WHEN length(t_notes) > 200 AND len(string_split_regex(t_notes, '[。！？.!?]+')) > 5 THEN 30 ELSE 0 END
      + CASE WHEN {any_kw('low', policy.strategic_words)} THEN 15 ELSE 0 END) AS transcription_value
  FROM low_text),
sums AS (
  SELECT *, topic_relevance * 25 + information_density * 15 + novelty * 15 + actionability * 15 + strategic_value * 20 + transcription_value * 10 AS cents,
    topic_relevance::DOUBLE * 25e-2 + information_density::DOUBLE * 15e-2 + novelty::DOUBLE * 15e-2 + actionability::DOUBLE * 15e-2
      + strategic_value::DOUBLE * 20e-2 + transcription_value::DOUBLE * 10e-2 AS total FROM dims),
ties AS (SELECT *, cents::DOUBLE / 100e0 AS tie, (cents::DOUBLE / 100e0) * 134217729e0 AS big FROM sums),
sides AS (SELECT *, CASE WHEN total <> tie THEN total - tie
    ELSE ((big - (big - tie)) * 100e0 - cents::DOUBLE) + (tie - (big - (big - tie))) * 100e0 END AS side FROM ties),
scored AS (
  SELECT *, (cents // 10 + CASE WHEN cents % 10 > 5 OR (cents % 10 = 5 AND (side > 0 OR (side = 0 AND (cents // 10) % 2 = 1))) THEN 1 ELSE 0 END)::DOUBLE / 10e0
    AS final_score FROM sides),
judged AS (
  SELECT *, CASE WHEN final_score >= {policy.full_threshold} THEN 'full' WHEN final_score >= {policy.preview_threshold} THEN 'preview' ELSE 'skip' END AS score_decision
  FROM scored)
"""


def classified(policy, source: str = "judged") -> str:
    """CTE: the ordered classification rules over `judged` (or another CTE with t_notes)."""
    return f"""
classified AS (
  SELECT *, CASE
    WHEN audio_url = '' THEN 'missing_audio'
    WHEN (contains(lower(audio_url), 'paywall') AND regexp_matches(lower(audio_url), 'intro|preview|trailer'))
      OR regexp_matches(lower(t_notes), '(?s)\\bsubscribe\\b.{{0,160}}\\bfull[- ]length episodes?\\b') THEN 'paywall_preview'
    WHEN starts_with({strip('lower(episode_title)')}, 'introducing:') AND regexp_matches(lower(t_notes), '\\blisten to (?:episode|the full|.+? on )') THEN 'cross_podcast_promo'
    WHEN {has_any('lower(t_notes)', policy.ad_words)} THEN 'ad_only'
    WHEN regexp_matches(lower(episode_title), 'trailer|preview episode|announcement|sneak peek|节目预告|内容预告') THEN 'trailer_or_announcement'
    WHEN duration_minutes < {policy.min_minutes} THEN 'below_minimum_duration'
    WHEN {strip('episode_title')} = '' OR (t_notes = '' AND duration_minutes < 5) THEN 'invalid_metadata'
    WHEN duration_minutes < {policy.short_minutes} THEN 'valid_short_episode'
    ELSE 'valid_episode' END AS reason_code
  FROM {source})
"""
