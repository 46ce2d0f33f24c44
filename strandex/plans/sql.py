"""DuckDB SQL of the queries, put together from common table expressions."""

from __future__ import annotations

from strandex.constants import CORE_DOMAINS, K, L, seed_mask, toggle_of
from strandex.plans.tables import _TO, LANGUAGES, REGION_PARENTS, TARGET_NATION_REGIONS, TARGET_REGIONS

_SHIFT = {i: 1 << 2 * i for i in range(32)}

DNA = f"""dna AS (
  SELECT doc_id AS read_id, CAST(doc_id AS VARCHAR) AS accession, 1000 + doc_id % (SELECT count(*) FROM supplier) AS taxid,
         CASE lang {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in LANGUAGES.items())} ELSE 'other' END AS domain,
         'doc' || doc_id || ' ' || source AS header,
         coalesce(translate(lower(regexp_replace(text, '[^A-Za-z\\n]', '', 'g')), 'abcdefghijklmnopqrstuvwxyz' || chr(10), '{_TO}'), '') AS seq
  FROM documents)"""

TREE = f"""nodes AS (
  SELECT * FROM (VALUES (1, 1), (131567, 1), (10239, 1), (2, 131567), (2157, 131567), (4751, 131567)) AS t(taxid, parent)
  UNION ALL SELECT 10 + r_regionkey, [{', '.join(map(str, REGION_PARENTS))}][r_regionkey + 1] FROM region
  UNION ALL SELECT 100 + n_nationkey, 10 + n_regionkey FROM nation
  UNION ALL SELECT 1000 + s_suppkey, 100 + s_nationkey FROM supplier),
paths AS (
  SELECT CAST(1 AS BIGINT) AS taxid, [CAST(1 AS BIGINT)] AS lineage
  UNION ALL SELECT CAST(n.taxid AS BIGINT), list_append(p.lineage, CAST(n.taxid AS BIGINT)) FROM paths p JOIN nodes n ON n.parent = p.taxid AND n.taxid <> 1),
targets AS (
  SELECT 10 + r_regionkey AS taxid FROM region WHERE r_regionkey IN ({', '.join(map(str, TARGET_REGIONS))})
  UNION SELECT 100 + n_nationkey FROM nation WHERE n_regionkey IN ({', '.join(map(str, TARGET_NATION_REGIONS))})),
steps AS (SELECT taxid, lineage, unnest(lineage) AS anc, generate_subscripts(lineage, 1) AS depth FROM paths),
rolled AS (SELECT s.taxid, CAST(max_by(s.anc, s.depth) AS BIGINT) AS target FROM steps s JOIN targets t ON s.anc = t.taxid GROUP BY s.taxid),
taxnames AS (SELECT CAST(10 + r_regionkey AS BIGINT) AS taxid, r_name AS name FROM region UNION ALL SELECT 100 + n_nationkey, n_name FROM nation),
core AS (SELECT unnest([{', '.join(map(str, CORE_DOMAINS))}])::BIGINT AS taxid)"""

def lmers(source: str, name: str, l: int = L) -> str:
    """``name(keys..., pos, forward, backward, cand)`` from ``source(id, mate, seq)``: codes doubled by looking ahead."""
    parts = [
        f"{name}_b AS (SELECT id, mate, CAST(generate_subscripts(c, 1) - 1 AS BIGINT) AS pos, unnest(c) AS c FROM (SELECT id, mate, string_split(seq, '') AS c FROM {source} WHERE seq <> ''))",
        f"{name}_1 AS (SELECT id, mate, pos, CAST(strpos('ACGT', upper(c)) - 1 AS BIGINT) AS q, CASE WHEN c IN ('A', 'C', 'G', 'T', 'a', 'c', 'g', 't') THEN q END AS f, 3 - f AS r FROM {name}_b)",
    ]
    size, at = 1, f"{name}_1"
    while size * 2 <= l:
        nxt = f"{name}_{size * 2}"
        parts.append(
            f"{nxt} AS (SELECT id, mate, pos, (f * {_SHIFT[size]}) + lead(f, {size}) OVER w AS f, r + {_SHIFT[size]} * lead(r, {size}) OVER w AS r FROM {at} WINDOW w AS (PARTITION BY id, mate ORDER BY pos))"
        )
        at, size = nxt, size * 2
    have = size
    if have < l:  # the last piece overlaps: its first bases are known already
        rest = l - have
        skip = have - rest
        parts.append(
            f"{name}_l AS (SELECT id, mate, pos, (f * {_SHIFT[rest]}) + (lead(f, {rest}) OVER w) % {_SHIFT[rest]} AS f, r + {_SHIFT[have]} * ((lead(r, {rest}) OVER w) // {_SHIFT[skip]}) AS r FROM {at} WINDOW w AS (PARTITION BY id, mate ORDER BY pos))"
        )
        at = f"{name}_l"
    parts.append(f"{name} AS (SELECT id, mate, pos, f, r, xor(least(f, r) & CAST({seed_mask()} AS BIGINT), CAST({toggle_of(l)} AS BIGINT)) AS cand FROM {at})")
    return ",\n".join(parts)


def windows(source: str, name: str, k: int = K, l: int = L) -> str:
    """``name(id, mate, pos, minimizer)``: a row for each window of k bases."""
    gap = k - l
    valid = f"count(f) OVER (PARTITION BY id, mate ORDER BY pos ROWS BETWEEN {gap - 1} PRECEDING AND CURRENT ROW) = {gap}" if gap else "f IS NOT NULL"
    least = f"min(CASE WHEN f IS NULL THEN NULL ELSE cand END) OVER (PARTITION BY id, mate ORDER BY pos ROWS BETWEEN {gap} PRECEDING AND CURRENT ROW)"
    lens = f"{name}_n AS (SELECT id, mate, length(seq) AS n FROM {source})"
    return lmers(source, f"{name}_m", l) + f""",
{lens},
{name}_w AS (SELECT m.id, m.mate, m.pos, CASE WHEN {valid.replace('PARTITION BY id, mate', 'PARTITION BY m.id, m.mate')} THEN xor({least.replace('PARTITION BY id, mate', 'PARTITION BY m.id, m.mate')}, CAST({toggle_of(l)} AS BIGINT)) END AS minimizer
  FROM {name}_m m JOIN {name}_n n ON m.id = n.id AND m.mate = n.mate WHERE m.pos <= n.n - {l}),
{name} AS (SELECT * FROM {name}_w WHERE pos >= {gap})"""


def runs(source: str, name: str) -> str:
    """``name(id, mate, run_no, minimizer, len)`` from windows: neighbours that are equal, nulls included."""
    return f"""{name}_c AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR minimizer IS DISTINCT FROM lag(minimizer) OVER w THEN 1 ELSE 0 END AS new FROM {source} WINDOW w AS (PARTITION BY id, mate ORDER BY pos)),
{name}_g AS (SELECT *, sum(new) OVER (PARTITION BY id, mate ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1 AS run_no FROM {name}_c),
{name} AS (SELECT id, mate, CAST(run_no AS BIGINT) AS run_no, any_value(minimizer) AS minimizer, count(*) AS len FROM {name}_g GROUP BY id, mate, run_no)"""


DOCS = "docs AS (SELECT read_id AS id, 1 AS mate, seq FROM dna)"
MATES = """mates AS (
  SELECT read_id AS id, 1 AS mate, left(seq, CAST(floor(length(seq) / 2) AS BIGINT)) AS seq, header FROM dna
  UNION ALL SELECT read_id, 2, substr(seq, CAST(floor(length(seq) / 2) AS BIGINT) + 1), header FROM dna)"""
#: (minimizer, taxid) as the index has it, with the steps before.
INDEX = ",\n".join(
    [
        DNA, TREE, DOCS, windows("docs", "win"),
        """seen AS (SELECT DISTINCT d.read_id, d.accession, d.taxid, d.domain, w.minimizer FROM win w JOIN dna d ON d.read_id = w.id WHERE w.minimizer IS NOT NULL),
own AS (SELECT s.*, r.target FROM seen s JOIN rolled r ON s.taxid = r.taxid),
own_taxa AS (SELECT DISTINCT minimizer, taxid FROM own),
taxa_n AS (SELECT minimizer, count(*) AS n FROM own_taxa GROUP BY minimizer),
common AS (SELECT o.minimizer, s.anc, max(s.depth) AS depth, count(*) AS n FROM own_taxa o JOIN steps s ON o.taxid = s.taxid GROUP BY o.minimizer, s.anc),
lca AS (SELECT c.minimizer, max_by(c.anc, c.depth) AS taxid FROM common c JOIN taxa_n t ON c.minimizer = t.minimizer AND c.n = t.n GROUP BY c.minimizer),
others AS (SELECT DISTINCT minimizer FROM seen s WHERE s.taxid NOT IN (SELECT taxid FROM rolled)),
survivors AS (SELECT l.minimizer, l.taxid FROM lca l ANTI JOIN others o ON l.minimizer = o.minimizer),
idx AS (SELECT s.minimizer, r.target AS taxid FROM survivors s JOIN rolled r ON s.taxid = r.taxid),
taxa AS (SELECT taxid FROM idx UNION SELECT taxid FROM core),
closure AS (SELECT s.anc, s.taxid AS "desc", CAST(s.depth - 1 AS INTEGER) AS depth FROM steps s JOIN taxa a ON s.anc = a.taxid JOIN taxa d ON s.taxid = d.taxid)""",
    ]
)
SETS = """ids AS (
  SELECT CAST(row_number() OVER (ORDER BY p.lineage, a.accession) - 1 AS INTEGER) AS acc_id, a.accession
  FROM (SELECT DISTINCT d.accession, r.target FROM dna d JOIN rolled r ON d.taxid = r.taxid WHERE d.taxid <> 9606) a JOIN paths p ON a.target = p.taxid),
sets AS (
  SELECT o.minimizer, list_sort(list(DISTINCT i.acc_id)) AS acc_ids FROM own o JOIN ids i ON o.accession = i.accession SEMI JOIN idx x ON o.minimizer = x.minimizer GROUP BY o.minimizer),
classes AS (SELECT acc_ids, count(*) AS minimizers FROM sets GROUP BY acc_ids)"""
DOMAINS = """pairs AS (SELECT DISTINCT domain, minimizer FROM seen),
domain_taxa AS (
  SELECT minimizer, CAST(CASE WHEN count(*) = 1 THEN max(CASE domain WHEN 'bacteria' THEN 2 WHEN 'archaea' THEN 2157 WHEN 'viral' THEN 10239 ELSE 4751 END)
         WHEN bool_or(domain = 'viral') AND bool_or(domain <> 'viral') THEN 1 WHEN bool_or(domain <> 'viral') THEN 131567 ELSE 10239 END AS BIGINT) AS taxid
  FROM pairs WHERE domain <> 'other' GROUP BY minimizer)"""


def classified(fallback: bool, reads: str = "mates") -> str:
    """Everything up to ``decided(read_id, status, taxid, best)`` and ``found``, over the mates of all reads."""
    other = "LEFT JOIN domain_taxa f ON f.minimizer = r.minimizer" if fallback else ""
    taxid = "coalesce(x.taxid, f.taxid)" if fallback else "x.taxid"
    background = "x.taxid IS NULL AND f.taxid IS NOT NULL" if fallback else "false"
    keep = "" if fallback else "WHERE anc NOT IN (SELECT taxid FROM core)"
    source = MATES if reads == "mates" else "single AS (SELECT read_id AS id, 1 AS mate, seq, header FROM dna)"
    return ",\n".join(
        [
            source, windows(reads, "rw"), runs("rw", "rr"),
            f"""found AS (SELECT r.id AS read_id, r.mate, r.run_no, r.minimizer, r.len, {taxid} AS taxid, {background} AS background FROM rr r LEFT JOIN idx x ON x.minimizer = r.minimizer {other}),
hits AS (SELECT *, CASE WHEN minimizer IS DISTINCT FROM lag(minimizer) OVER (PARTITION BY read_id, mate ORDER BY run_no) THEN 1 ELSE 0 END AS opens FROM found WHERE taxid IS NOT NULL),
weights AS (
  SELECT read_id, taxid, CAST(sum(len) AS BIGINT) AS weight, CAST(coalesce(sum(opens) FILTER (WHERE NOT background), 0) AS BIGINT) AS groups,
         CAST(coalesce(sum(opens) FILTER (WHERE background), 0) AS BIGINT) AS background_groups
  FROM hits GROUP BY read_id, taxid),
per_read AS (SELECT read_id, sum(groups) + greatest(sum(background_groups) - 1, 0) AS effective FROM weights GROUP BY read_id),
pw AS (
  SELECT w.read_id, c."desc" AS taxid, CAST(sum(w.weight) AS BIGINT) AS path_weight FROM weights w JOIN closure c ON c.anc = w.taxid
  WHERE w.read_id IN (SELECT read_id FROM per_read WHERE effective >= 2) GROUP BY w.read_id, c."desc"),
best AS (SELECT read_id, taxid FROM pw QUALIFY path_weight = max(path_weight) OVER (PARTITION BY read_id)),
nbest AS (SELECT read_id, count(*) AS n, min(taxid) AS one, list_sort(list(taxid)) AS best FROM best GROUP BY read_id),
cand AS (SELECT b.read_id, c.anc, max(c.depth) AS depth FROM best b JOIN closure c ON c."desc" = b.taxid JOIN nbest n ON n.read_id = b.read_id GROUP BY b.read_id, c.anc, n.n HAVING count(*) = n.n),
low AS (SELECT read_id, max_by(anc, depth) AS taxid FROM cand {keep} GROUP BY read_id),
decided AS (
  SELECT d.read_id, CASE WHEN n.read_id IS NULL THEN 'U' WHEN n.n = 1 OR l.taxid IS NOT NULL THEN 'C' ELSE 'A' END AS status,
         CAST(CASE WHEN n.n = 1 THEN n.one ELSE l.taxid END AS BIGINT) AS taxid,
         CASE WHEN n.n > 1 AND l.taxid IS NULL THEN n.best END AS best
  FROM dna d LEFT JOIN nbest n ON n.read_id = d.read_id LEFT JOIN low l ON l.read_id = d.read_id)""",
        ]
    )


def with_(*parts: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + select
