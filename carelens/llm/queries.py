"""The registered queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelens.session import ensure_checkpoint_dir, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ensure_checkpoint_dir(spark)
        ship_package(spark)
        return fn(spark, sf_dir)
    QUERIES[fn.__name__] = run
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def llm_queries():
    return dict(QUERIES)


def llm_oracles():
    return dict(ORACLES)


@_query
def op10_chat(spark, sf_dir):
    """Every conversation, and conversation -7, whose texts hold control strings."""
    from carelens.llm.chat import conversation_digest, format_conversations
    tricky = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return conversation_digest(format_conversations(turns))


# formatted_chars follows from the template: per merged block the marks and the
# role, per further turn of a block the parting mark, and the escaped texts.
ORACLES["op10_chat"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
o AS (
  SELECT *, row_number() OVER w AS rn,
         coalesce(role = lag(role) OVER w, false) AS same
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY rn), '')) AS loss_sha256,
  CAST(sum(length(text) + length(regexp_replace(text, '[^\\<>]', '', 'g'))
      + CASE WHEN same THEN 6 ELSE 15 + length(role) + length(regexp_replace(role, '[^\\<>]', '', 'g')) END) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id
"""


@_query
def op1_repetition(spark, sf_dir):
    """Repetition measures and the verdict for every document."""
    from carelens.llm.repetition import repetition_quality
    return repetition_quality(_table(spark, sf_dir, "documents"))


@_query
def op2_tokens(spark, sf_dir):
    """Byte-level BPE token counts of every document."""
    import public_tokenizers

    from carelens.llm.tokens import count_tokens
    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query
def op8_secrets(spark, sf_dir):
    """Plain and encoded secrets of every document."""
    from carelens.llm.secrets import scan_secrets
    return scan_secrets(_table(spark, sf_dir, "documents"))


@_query
def op6_decontaminate(spark, sf_dir):
    """Words of every document that lie in a ten-word window of a benchmark item."""
    from carelens.llm.decontaminate import contamination_digest, find_contamination
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination_digest(find_contamination(docs, _table(spark, sf_dir, "benchmark")))


ORACLES["op6_decontaminate"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
hit AS (SELECT DISTINCT doc_id, i, dw.k AS k, item_id FROM dw JOIN bw ON dw.phrase = bw.phrase AND dw.k = bw.k),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


@_query
def op3_simhash(spark, sf_dir):
    """Fingerprint and near-duplicate component of every document."""
    from carelens.llm.simhash import simhash_groups
    return simhash_groups(_table(spark, sf_dir, "documents"))


@_query
def op5_substring_dedup(spark, sf_dir):
    """Words of every document that repeat fifty at a time from a smaller id."""
    from carelens.llm.superkmer import remove_repeats
    return remove_repeats(_table(spark, sf_dir, "documents"), with_text=False)


ORACLES["op5_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS phrase
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT *, min(doc_id) OVER (PARTITION BY phrase) AS first_id FROM x),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM f WHERE doc_id > first_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM words w ANTI JOIN gone g ON w.doc_id = g.doc_id AND w.p = g.p GROUP BY w.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""


@_query
def op4_toxicity(spark, sf_dir):
    """Toxicity score and offending offsets of every document."""
    from carelens.llm.toxicity import fit_toxicity, score_toxicity
    docs = _table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, _table(spark, sf_dir, "labels")))


@_query
def op7_mixing(spark, sf_dir):
    """The documents chosen for the target weights, and how often each is taken."""
    from carelens.llm.mixing import BUDGET_SHARE, MAX_EPOCHS, SEED, WEIGHTS, default_levels, mix_sources
    chosen = mix_sources(_table(spark, sf_dir, "documents"), default_levels(), WEIGHTS, budget_share=BUDGET_SHARE,
                         max_epochs=MAX_EPOCHS, seed=SEED)
    return chosen.select(F.col("row.doc_id").alias("doc_id"), "branch.*", "tokens", "copies")


def _mixing_twin() -> str:
    """The same mixture with plain running sums."""
    def share(name, source, parent):
        family = f"PARTITION BY {parent}" if parent else ""
        return f"""
{name}_a AS (SELECT *, sum(cap) OVER r - cap AS cb, sum(w) OVER r - w AS wb, sum(w) OVER ({family}) AS wt FROM {source}
  WINDOW r AS ({family} ORDER BY CAST(cap AS DOUBLE) / w, {name} ROWS UNBOUNDED PRECEDING)),
{name}_b AS (SELECT *, CAST(cap AS HUGEINT) * CAST(wt - wb AS HUGEINT) <= CAST(given - cb AS HUGEINT) * w AS f FROM {name}_a),
{name}_c AS (SELECT *, CAST(given - sum(CASE WHEN f THEN cap ELSE 0 END) OVER ({family}) AS HUGEINT) AS rest,
    CAST(sum(CASE WHEN f THEN 0 ELSE w END) OVER ({family}) AS HUGEINT) AS wr,
    CAST(sum(CASE WHEN f THEN 0 ELSE w END) OVER r AS HUGEINT) AS wu FROM {name}_b
  WINDOW r AS ({family} ORDER BY CAST(cap AS DOUBLE) / w, {name} ROWS UNBOUNDED PRECEDING)),
{name}_g AS (SELECT *, CASE WHEN f THEN cap ELSE CAST((rest * wu) // wr - (rest * (wu - w)) // wr AS BIGINT) END AS grant_ FROM {name}_c)"""
    return f"""
WITH d AS (SELECT doc_id, 'd' || (CAST(right(regexp_extract(source, '([0-9]+)$', 1), 4) AS INTEGER) % 4) AS domain, lang, source,
                  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens FROM documents),
leaf AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS have FROM d GROUP BY ALL),
n1 AS (SELECT domain, CAST(sum(have) * 2 AS BIGINT) AS cap, CASE domain WHEN 'd0' THEN 1 WHEN 'd1' THEN 2 WHEN 'd2' THEN 3 ELSE 4 END AS w,
              (SELECT CAST(floor(sum(have) * CAST(0.9 AS DOUBLE)) AS BIGINT) FROM leaf) AS given FROM leaf GROUP BY domain),
{share('domain', 'n1', '')},
n2 AS (SELECT l.domain, l.lang, CAST(sum(have) * 2 AS BIGINT) AS cap, CASE l.lang WHEN 'en' THEN 4 WHEN 'es' THEN 1 ELSE 2 END AS w,
              any_value(g.grant_) AS given FROM leaf l JOIN domain_g g USING (domain) GROUP BY l.domain, l.lang),
{share('lang', 'n2', 'domain')},
n3 AS (SELECT l.domain, l.lang, l.source, have * 2 AS cap, have, 1 AS w, g.grant_ AS given FROM leaf l JOIN lang_g g ON l.domain = g.domain AND l.lang = g.lang),
{share('source', 'n3', 'domain, lang')},
plan AS (SELECT domain, lang, source, CASE WHEN have > 0 THEN grant_ // have ELSE 0 END AS epochs,
                grant_ - CASE WHEN have > 0 THEN grant_ // have ELSE 0 END * have AS rest FROM source_g),
o AS (SELECT d.*, epochs, rest, sum(tokens) OVER (PARTITION BY domain, lang, source
        ORDER BY md5('mix|' || epochs || '|' || doc_id), CAST(doc_id AS VARCHAR) ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN plan USING (domain, lang, source))
SELECT doc_id, domain, lang, source, tokens, CAST(epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM o WHERE epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END > 0
"""


ORACLES["op7_mixing"] = _mixing_twin()


#: The registered query's key; a user passes a secret of their own.
SURROGATE_KEY = b"registered-query"


@_query
def op9_pii(spark, sf_dir):
    """Every document's text with surrogates for its personal data, and what was replaced."""
    from carelens.llm.surrogates import replace_entities
    out = replace_entities(_table(spark, sf_dir, "documents"), SURROGATE_KEY)
    listed = F.transform("entities", lambda e: F.concat_ws(":", e["kind"], e["begin"], e["stop"]))
    return out.select(F.col("row.doc_id").alias("doc_id"), "text", F.coalesce(F.size("entities"), F.lit(0)).cast("long").alias("n_entities"),
                      F.coalesce(F.array_join(listed, ","), F.lit("")).alias("entities"))


def _repetition_twin() -> str:
    from carelens.llm.repetition import LIMITS, LINE_LIMIT
    grams = "".join(f""",
x{k} AS (SELECT *, row_number() OVER (PARTITION BY doc_id, phrase ORDER BY i) AS nth, count(*) OVER (PARTITION BY doc_id, phrase) AS times
  FROM (SELECT doc_id, i, array_to_string(w[i:i + {k - 1}], ' ') AS phrase
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - {k - 2})) AS i FROM d WHERE len(w) >= {k}))),
c{k} AS (SELECT c.doc_id, sum(length(w[p])) AS chars FROM (SELECT DISTINCT doc_id, unnest(range(i, i + {k})) AS p FROM x{k} WHERE nth > 1) c
  JOIN d USING (doc_id) GROUP BY c.doc_id)""" for k in LIMITS)
    shares = ", ".join(f"coalesce(c{k}.chars, 0)::DOUBLE / greatest(word_chars, 1)::DOUBLE AS repeat_chars_{k}" for k in LIMITS)
    joins = " ".join(f"LEFT JOIN c{k} ON c{k}.doc_id = m.doc_id" for k in LIMITS)
    within = " AND ".join(f"repeat_chars_{k} <= {limit}::DOUBLE" for k, limit in LIMITS.items())
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols FROM d),
l AS (SELECT doc_id, size, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) AS nth
      FROM (SELECT doc_id, line, k, strlen(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g')) AS size
            FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS k FROM d))
      WHERE size > 0),
lines AS (SELECT doc_id, count(*) FILTER (WHERE nth > 1) AS dup, coalesce(sum(size) FILTER (WHERE nth > 1), 0)::DOUBLE / sum(size)::DOUBLE AS share
          FROM l GROUP BY doc_id){grams},
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM x5 WHERE times > 1) GROUP BY doc_id),
a AS (SELECT m.*, CAST(coalesce(lines.dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, {shares},
             coalesce(lines.share, 0)::DOUBLE AS dup_line_chars
      FROM m LEFT JOIN lines ON lines.doc_id = m.doc_id LEFT JOIN r ON r.doc_id = m.doc_id {joins}),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM a)
SELECT *, NOT base_failed AND dup_line_chars <= {LINE_LIMIT}::DOUBLE AND {within} AS kept FROM b
"""


ORACLES["op1_repetition"] = _repetition_twin()


@_query
def op11_alignment(spark, sf_dir):
    """Byte-level BPE against piece BPE: groups, links and their counts of every document."""
    import public_tokenizers

    from carelens.llm.alignment import alignment_counts
    return alignment_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                            public_tokenizers.path("piece_bpe_32k.model"))


@_query
def op12_merkle(spark, sf_dir):
    """Every document's proof against the manifest, a third of them with tampered texts."""
    from carelens.llm.merkle import manifest_proofs
    out = manifest_proofs(_table(spark, sf_dir, "documents"), tampered=F.crc32(F.col("doc_id").cast("string")) % 3 == 0)
    return out.select("doc_id", "leaf", "subroot", "root", F.col("siblings").alias("proof_sha256"), "folded_root", "verified")


def _merkle_twin(levels: int = 7, top_levels: int = 3) -> str:
    """Trees of at most 8^levels rows a language and 8^top_levels languages, level by level."""
    def digest(text):
        fields = ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)
        return "sha256(concat(" + ", ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + "))"

    def tree(name, start, depth):
        out = f"{name}0 AS ({start})"
        for k in range(depth):
            out += f""",
{name}{k}s AS (SELECT *, coalesce(string_agg(h, '') OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS bef,
  coalesce(string_agg(h, '') OVER (r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS aft
  FROM {name}{k} WINDOW r AS (PARTITION BY g, pos // 8 ORDER BY pos)),
{name}{k + 1} AS (SELECT g, pos // 8 AS pos, CASE WHEN any_value(m) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE any_value(h) END AS h,
  (any_value(m) + 7) // 8 AS m FROM {name}{k} GROUP BY g, pos // 8)"""
        return out

    def folds(name, state, depth, key, pos):
        out = ""
        for k in range(depth):
            out += f""",
{state}{k + 1} AS (SELECT f.* REPLACE (CASE WHEN m > 1 THEN sha256(bef || f.fold || aft) ELSE f.fold END AS fold, f.proof || bef || aft AS proof)
  FROM {state}{k} f JOIN {name}{k}s s ON s.g = f.{key} AND s.pos = f.{pos} // {8 ** k})"""
        return out

    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    byte = "list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    codes = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda z: CAST(ascii(z) AS BIGINT))"
    crc = f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {codes}), lambda c, b: {byte}), 4294967295)"
    return f"""
WITH d AS (SELECT doc_id, coalesce('v' || lang, 'n') AS g, {digest('text')} AS leaf,
                  CASE WHEN {crc} % 3 = 0 THEN {digest(low)} ELSE {digest('text')} END AS other FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, other) - 1 AS pos, count(*) OVER (PARTITION BY g) AS m FROM d),
{tree('t', 'SELECT g, pos, leaf AS h, m FROM p', levels)},
{tree('u', "SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS pos, h, count(*) OVER () AS m FROM t" + str(levels), top_levels)},
names AS (SELECT g AS name, row_number() OVER (ORDER BY g) - 1 AS place, '' AS top FROM t{levels}),
f0 AS (SELECT doc_id, leaf, g, pos, other AS fold, '' AS proof FROM p){folds('t', 'f', levels, 'g', 'pos')},
e0 AS (SELECT f.*, place, top FROM f{levels} f JOIN names ON name = g){folds('u', 'e', top_levels, 'top', 'place')}
SELECT doc_id, leaf, t.h AS subroot, u.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = u.h AS verified
FROM e{top_levels} e JOIN t{levels} t ON t.g = e.g CROSS JOIN u{top_levels} u
"""


ORACLES["op12_merkle"] = _merkle_twin()


@_query
def op13_suffix_dedup(spark, sf_dir):
    """Bytes of every document that repeat fifty at a time from a smaller id."""
    from carelens.llm.suffixes import remove_byte_repeats
    return remove_byte_repeats(_table(spark, sf_dir, "documents"), with_text=False)


ORACLES["op13_suffix_dedup"] = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (SELECT doc_id, base, substr(x, 2 * base + 1, 2 * 249) AS y
      FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 49, 200)) AS base FROM d WHERE len(x) >= 100)),
s AS (SELECT doc_id, base + j AS i, substr(y, 2 * j + 1, 100) AS phrase FROM (SELECT *, unnest(range(0, len(y) // 2 - 49)) AS j FROM c)),
m AS (SELECT phrase, min(doc_id) AS first_id FROM s GROUP BY phrase),
gone AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM s JOIN m USING (phrase) WHERE doc_id > first_id),
runs AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM gone),
spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM runs GROUP BY doc_id, run),
between AS (SELECT doc_id, run, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY run), 0) AS z FROM spans),
g AS (SELECT d.doc_id, count(*) AS spans, sum(b - a) AS n,
             string_agg(substr(x, 2 * z + 1, 2 * (a - z)), '' ORDER BY run) || substr(any_value(x), 2 * max(b) + 1) AS kept
      FROM between JOIN d ON d.doc_id = between.doc_id GROUP BY d.doc_id)
SELECT d.doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""
