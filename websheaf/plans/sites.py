"""Queries over pages of documentation sites: the documents' lines with the sites' chrome strewn among them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from websheaf.functions import sites
from websheaf.plans.fixtures import load

_NAMES = ["tor", "cookieyes", "onetrust", "docs/trafilatura", "footer/other"]
#: Lines that take the place of a document's own, by (doc_id + line number) mod EVERY.
EVERY = 29
_CHROME = {
    1: "View for:", 3: "Expand all Collapse all", 5: "Search for:Search Button", 7: "![skip icon](https://x/skip.svg)", 8: "Jump to", 9: "[Part](https://x/#part)", 11: "## Related articles", 14: "## Next part",
    16: "[](https://x/#a)", 17: "2 of 9[](https://x/)", 19: "## ", 20: "", 22: "", 23: "### ", 24: "[](https://x/#b)", 26: "Copy page", 28: "#### ",
}
#: Lines that end pages, on few documents.
_ENDS = {0: "On this page", 1: "Was this article helpful?", 2: "© 2024 the authors"}
_SOURCE = "<!-- source: https://x/ -->"


def _pages(s: SparkSession, d: str) -> DataFrame:
    n, end = F.col("doc_id"), F.element_at(F.array(*map(F.lit, _ENDS.values())), (F.col("doc_id") % 3 + 1).cast("int"))

    def line(x, i):
        place = F.pmod(n + i, F.lit(EVERY))
        out = F.when((place == 12) & (i > 40), end)
        for k, chrome in _CHROME.items():
            out = out.when(place == k, F.lit(chrome))
        return out.otherwise(x)

    lines = F.concat(F.array(*map(F.lit, [_SOURCE, "", "", "# Title"])), F.transform(F.split("text", "\n"), line))
    return load(s, d, "documents").select("doc_id", F.element_at(F.array(*map(F.lit, _NAMES)), (n % len(_NAMES) + 1).cast("int")).alias("site"), F.array_join(lines, "\n").alias("text"))


def _site_rules(s: SparkSession, d: str) -> DataFrame:
    return sites.cleaned(_pages(s, d), sites.rule_table(s))


QUERIES = {"c19_site_rules": _site_rules}

_CASES = " ".join(f"WHEN {k} THEN '{v}'" for k, v in _CHROME.items())
_UP_TO = "OVER (PARTITION BY doc_id ORDER BY i)"

SQL = {
    "c19_site_rules": rf"""WITH p AS (
  SELECT doc_id, (['{"', '".join(_NAMES)}'])[(doc_id % {len(_NAMES)} + 1)::INTEGER] AS site, ['{_SOURCE}', '', '', '# Title'] || list_transform(string_split(text, chr(10)),
    lambda x, k: CASE WHEN (doc_id + k - 1) % {EVERY} = 12 AND k > 41 THEN (['{"', '".join(_ENDS.values())}'])[(doc_id % 3 + 1)::INTEGER] ELSE CASE (doc_id + k - 1) % {EVERY} {_CASES} ELSE x END END) AS lines
  FROM documents WHERE text IS NOT NULL
), l AS (
  SELECT *, max(i) FILTER (NOT regexp_matches(line, '^\s*$')) OVER (PARTITION BY doc_id) AS last_i FROM (SELECT doc_id, site, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM p) x
), f AS (
  SELECT *, regexp_matches(line, '^\s*$') AS blank, coalesce(lag(line) OVER w, '') AS prev, coalesce(lag(line, 2) OVER w, '') AS prev2,
    regexp_matches(line, '^\[\]\(https://[^)]+\)\s*$') AS anchor, regexp_matches(line, '^#{{1,6}}\s*$') AS split,
    arg_min(line, i) FILTER (NOT regexp_matches(line, '^\s*$')) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next,
    min(i) FILTER (NOT regexp_matches(line, '^\s*$')) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_i,
    coalesce(max(i) FILTER (trim(line) = '## Related articles') {_UP_TO}, -1) AS related,
    coalesce(max(i) FILTER (regexp_matches(line, '^\s*## ') AND trim(line) <> '## Related articles') {_UP_TO}, -1) AS other,
    max(CASE site WHEN 'cookieyes' THEN trim(line) = 'Was this article helpful?' WHEN 'docs/trafilatura' THEN trim(line) IN ('On this page', '### This Page')
      WHEN 'onetrust' THEN i = last_i AND regexp_matches(trim(line), '^(\[[^\]]+\]\([^)]+\))+$')
      WHEN 'footer/other' THEN regexp_matches(line, '^(Copyright ©|© Copyright|© \d{{4}})') ELSE false END) {_UP_TO} AS over
  FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), m AS (
  SELECT *, split AND next IS NOT NULL AND NOT starts_with(ltrim(next), '#') AND NOT regexp_matches(trim(next), '^\[\]\(https://[^)]+\)\s*$') AS merged FROM f
), c AS (
  SELECT *, coalesce(max(next_i) FILTER (merged) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) >= i AS taken FROM m
), k AS (
  SELECT doc_id, site, i, CASE WHEN site = 'onetrust' AND merged THEN regexp_extract(line, '^#+') || ' ' || trim(next) ELSE line END AS line, blank FROM c
  WHERE NOT over AND CASE site
    WHEN 'tor' THEN line NOT IN ('View for:', 'Expand all Collapse all') AND prev <> 'View for:'
    WHEN 'cookieyes' THEN related <= other AND NOT (blank AND i < 3) AND line NOT IN ('Search for:Search Button', '![skip icon](https://x/skip.svg)')
      AND NOT (line = 'Jump to' AND starts_with(prev, '![skip')) AND NOT (line = '[Part](https://x/#part)' AND prev = 'Jump to' AND starts_with(prev2, '![skip'))
    WHEN 'onetrust' THEN i > 2 AND NOT taken AND NOT anchor AND NOT regexp_matches(line, '^\d+ of \d+\[\]\([^)]*\)\s*$') AND (merged OR NOT split)
    ELSE i > 2 END
), t AS (
  SELECT doc_id, site, string_agg(line, chr(10) ORDER BY i) AS body FROM (SELECT *, lag(blank) OVER (PARTITION BY doc_id ORDER BY i) AS after_blank FROM k) x
  WHERE NOT (site = 'onetrust' AND blank AND coalesce(after_blank, false)) GROUP BY ALL
), u AS (
  SELECT doc_id, site, CASE WHEN site = 'footer/other' THEN regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '\[docs\]\[\]\(https?://[^)]*\)\n?', '', 'g'), '(?m)^Copy page\s*$', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')
    ELSE regexp_replace(body, '(\n[^\S\n]*)+$', '') END AS body FROM t
)
SELECT doc_id, site, CASE site WHEN 'tor' THEN '' WHEN 'cookieyes' THEN '' WHEN 'footer/other' THEN '{_SOURCE}' || repeat(chr(10), 4) ELSE '{_SOURCE}' || repeat(chr(10), 2) END || body || chr(10) AS text FROM u
UNION ALL SELECT doc_id, (['{"', '".join(_NAMES)}'])[(doc_id % {len(_NAMES)} + 1)::INTEGER], NULL FROM documents WHERE text IS NULL""",
}
