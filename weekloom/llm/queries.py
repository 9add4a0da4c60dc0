"""One query per operator, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.llm import (
    ann,
    decontam,
    langid,
    licenses,
    merkle,
    packing,
    parity,
    secret_scan,
    simhash,
    spelling,
    substring,
    tokens,
    warc,
)
from weekloom.session import new_table_path, write_table

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query
def op3_token_counts(spark, d):
    """A cache of its own per call, so that every distinct text is a miss."""
    return tokens.count_tokens(_table(spark, d, "documents"), new_table_path(spark, "token-cache"))


@query
def op5_simhash_groups(spark, d):
    return simhash.near_groups(_table(spark, d, "documents"))


@query
def op7_packing(spark, d):
    return packing.pack_documents(_table(spark, d, "documents"))


@query
def op2_warc(spark, d):
    files = warc.save_archives(_table(spark, d, "pages"), new_table_path(spark, "archives"))
    return warc.read_files(files, payloads=False).drop("payload", "url")


_HEX_PART = "('0x' || substr(digest, {}, 5))::INTEGER"
_LETTER = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({} >> {}) & 31) + 1, 1)"
_BASE32 = " || ".join(_LETTER.format(_HEX_PART.format(1 + 5 * k), 15 - 5 * j) for k in range(8) for j in range(4))
SQL["op2_warc"] = f"""
WITH payloads AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
     digests AS (SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS digest,
                        max(page_id) OVER (PARTITION BY payload) AS best FROM payloads)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM best THEN NULL ELSE best END AS refers_to
FROM digests"""


@query
def op4_secret_scan(spark, d):
    found = secret_scan.scan_secrets(_table(spark, d, "documents"))

    def spans_of(kind):
        return F.size(F.filter("spans", lambda span: span["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [spans_of(kind) for kind in secret_scan.KINDS]
    digest = F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, F.col("all_spans").alias("spans"))


@query
def op9_license_scan(spark, d):
    return licenses.scan_licenses(_table(spark, d, "documents"))


def _license_sql() -> str:
    """The phrases as rows of words that follow each other, the templates as sets of words."""
    folded = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    split = r"string_split_regex({}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

    def stands(phrase: str) -> str:
        return " AND ".join(f"w{k} = '{w}'" for k, w in enumerate(phrase.split()))

    phrases = " UNION ALL ".join(
        f"SELECT doc_id, p, '{label}' AS label FROM ahead WHERE {stands(phrase)}" for phrase, label in licenses.PHRASES
    )
    templates = ", ".join(
        f"({number}, '{label}', '{word.decode()}', {word.decode() in licenses.NAMES[number][0].split()})"
        for number, (label, text) in enumerate(licenses.TEMPLATES)
        for word in sorted(set(licenses._words(text.encode())))
    )
    barred = ", ".join(f"({number}, '{word}')" for number, (_, words) in enumerate(licenses.NAMES) for word in words.split())
    leads = ", ".join(f"lead(word, {k}) OVER d AS w{k}" for k in range(4))
    return f"""
WITH folded AS (SELECT doc_id, {folded} AS text FROM documents),
     words AS (SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS p
               FROM (SELECT doc_id, unnest(parts) AS word, generate_subscripts(parts, 1) AS i
                     FROM (SELECT doc_id, {split.format("text")} AS parts FROM folded)) WHERE word <> ''),
     ahead AS (SELECT doc_id, p, {leads} FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY p)),
     places AS ({phrases}),
     base AS (SELECT doc_id, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word,
                     string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY 1),
     lines AS (SELECT doc_id, i, list_filter({split.format("line")}, lambda w: w <> '') AS words
               FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i
                     FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM folded))),
     numbered AS (SELECT *, sum(CASE WHEN len(words) = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS par
                  FROM lines),
     blocks AS (SELECT DISTINCT doc_id, 'l' || i AS block, unnest(words) AS word FROM numbered
                UNION SELECT DISTINCT doc_id, 'p' || par, unnest(words) FROM numbered),
     templates AS (SELECT t, label, word, named, count(*) OVER (PARTITION BY t) AS n,
                          count(*) FILTER (named) OVER (PARTITION BY t) AS n_named
                   FROM (VALUES {templates}) v(t, label, word, named)),
     others AS (SELECT DISTINCT doc_id, block, t FROM blocks JOIN (VALUES {barred}) v(t, word) USING (word)),
     near AS (SELECT doc_id, block, t, label, count(*) / n AS share FROM blocks JOIN templates USING (word)
              GROUP BY doc_id, block, t, label, n, n_named
              HAVING count(*) >= {licenses.CONTAINMENT} * n - 1e-9 AND count(*) FILTER (named) = n_named),
     matches AS (SELECT doc_id, label, share FROM near ANTI JOIN others USING (doc_id, block, t)),
     every AS (SELECT doc_id, label, NULL AS share FROM places UNION ALL SELECT * FROM matches),
     found AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS share
               FROM every GROUP BY 1),
     sizes AS (SELECT doc_id, count(*) AS n_words FROM words GROUP BY 1)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)"""


SQL["op9_license_scan"] = _license_sql()


@query
def op10_language_id(spark, d):
    docs = _table(spark, d, "documents")
    model = langid.train(docs.where(~langid.held_out()))
    own = docs.select("doc_id", "text", langid.held_out().alias("held_out"))
    return langid.predict(own, model).drop("text")


@query
def op6_substring_dedup(spark, d):
    return substring.remove_repeats(_table(spark, d, "documents"), with_text=False).drop("kept")


SQL["op6_substring_dedup"] = r"""
WITH split AS (SELECT doc_id, string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') AS parts FROM documents),
     words AS (SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p
               FROM (SELECT doc_id, unnest(parts) AS word, generate_subscripts(parts, 1) AS i FROM split)
               WHERE word <> ''),
     windows AS (SELECT doc_id, p, string_agg(word, ' ') OVER w AS words, count(*) OVER w AS n FROM words
                 WINDOW w AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
     repeated AS (SELECT doc_id, p FROM windows WHERE n = 35 QUALIFY count(*) OVER (PARTITION BY words) > 1),
     gone AS (SELECT DISTINCT doc_id, unnest(generate_series(p, p + 34)) AS p FROM repeated),
     kept AS (SELECT doc_id, count(*) AS n_words, count(g.p) AS n_removed,
                     string_agg(word, ' ' ORDER BY words.p) FILTER (g.p IS NULL) AS text
              FROM words LEFT JOIN gone g USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)"""


@query
def op8_cross_polytope(spark, d):
    vectors = _table(spark, d, "embeddings")
    return ann.nearest(vectors, F.col("vec_id") % 20 == 0)


@query
def op1_decontamination(spark, d):
    return decontam.find_leaks(_table(spark, d, "documents"), _table(spark, d, "benchmark"))


@query
def op11_spelling_variants(spark, d):
    return spelling.group_variants(_table(spark, d, "documents"))


# The checksum's table as a list, and a checksum folded over a list of bytes.
_CRC_TABLE = (
    "SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), "
    "lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tbl"
)
_CRC = (
    "xor(list_reduce(list_concat([4294967295], {bytes}), "
    "lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1])), 4294967295)"
)
# UTF-8 of text below U+0800.
_BYTES = (
    "flatten(list_transform(string_split({text}, ''), lambda s: CASE WHEN unicode(s) < 128 "
    "THEN [unicode(s)::BIGINT] ELSE [192 + (unicode(s) >> 6)::BIGINT, 128 + (unicode(s) & 63)::BIGINT] END))"
)
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL["op11_spelling_variants"] = rf"""
WITH RECURSIVE t AS ({_CRC_TABLE}),
     runs AS (SELECT doc_id, {_FOLD.format("run")} AS run, count(*) AS k
              FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)
              GROUP BY 1, 2),
     hashed AS (SELECT run, k, {_CRC.format(bytes=_BYTES.format(text="coalesce(doc_id::VARCHAR, '') || ':' || run"))} AS h
                FROM runs, t),
     edited AS (SELECT k, CASE WHEN h % 199 = 0
                          THEN substr(run, 1, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2)
                          ELSE run END AS word FROM hashed),
     words AS (SELECT word, sum(k)::BIGINT AS n FROM edited WHERE length(word) >= 6 GROUP BY 1 HAVING sum(k) >= 5),
     shorter AS (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest
                 FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INTEGER AS p FROM words)),
     near AS (SELECT a.word, a.n, b.word AS other, b.n AS m FROM shorter a JOIN shorter b USING (p, rest) WHERE a.word <> b.word
              UNION SELECT s.word, s.n, w.word, w.n FROM shorter s JOIN words w ON s.rest = w.word
              UNION SELECT w.word, w.n, s.word, s.n FROM shorter s JOIN words w ON s.rest = w.word),
     best AS (SELECT word, count(*) AS n_near, max(m) AS m FROM near GROUP BY 1),
     named AS (SELECT word, min(other) AS form FROM near JOIN best USING (word, m) GROUP BY 1),
     formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * w.n THEN f.form END AS form,
                       CASE WHEN m >= 5 * w.n THEN m END AS form_n
                FROM words w LEFT JOIN best USING (word) LEFT JOIN named f USING (word)),
     follow AS (SELECT word, word AS here, 0 AS depth FROM formed
                UNION ALL SELECT o.word, f.form, depth + 1 FROM follow o JOIN formed f ON f.word = o.here WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n
FROM formed f JOIN (SELECT word, arg_max(here, depth) AS root FROM follow GROUP BY 1) r USING (word)"""


@query
def op12_merkle_manifest(spark, d):
    id_text = F.col("doc_id").cast("string").cast("binary")
    return merkle.manifest(
        _table(spark, d, "documents"),
        tampered={"text": merkle.lower_ascii(F.col("text"))},
        tampered_where=F.crc32(id_text) % 3 == 0,
    )


def _merkle_sql(levels: int = 8, key_levels: int = 4) -> str:
    """One table per level of the trees: enough for 8 ** ``levels`` rows of a key and 8 ** ``key_levels`` keys."""

    def part(value: str) -> str:
        text = f"{value}::VARCHAR"
        return f"coalesce(strlen({text}) || ':' || {text}, '-')"

    others = [part(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf = "sha256(" + " || ".join([*others, part("text")]) + ")"
    tampered = "sha256(" + " || ".join([*others, part("(" + _FOLD.format("text") + ")")]) + ")"
    digits = "list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)"
    ctes = [
        f"t AS ({_CRC_TABLE})",
        f"leaves AS (SELECT doc_id, lang, {leaf} AS h, CASE WHEN {_CRC.format(bytes=digits)} % 3 = 0 THEN {tampered} END AS shown"
        " FROM documents, t)",
        "l0 AS (SELECT doc_id, coalesce(lang, '') AS k, lang IS NULL AS nokey, h, shown,"
        " row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS pos FROM leaves)",
        "n0 AS (SELECT k, nokey, pos, h FROM l0)",
    ]

    def level(source: str, target: str, keys: str) -> list[str]:
        """The next level, where a tree of one node keeps it, and what stands beside each node."""
        run = f"PARTITION BY {keys}pos // 8 ORDER BY pos ROWS BETWEEN"
        return [
            f"c{source} AS (SELECT *, count(*) OVER ({'PARTITION BY ' + keys.rstrip(', ') if keys else ''}) AS m FROM {source})",
            f"{target} AS (SELECT {keys}pos // 8 AS pos, CASE WHEN max(m) > 1 THEN sha256(string_agg(h, '' ORDER BY pos))"
            f" ELSE max(h) END AS h FROM c{source} GROUP BY {keys}pos // 8)",
            f"s{source} AS (SELECT {keys}pos, m > 1 AS deeper,"
            f" coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,"
            f" coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt FROM c{source})",
        ]

    for i in range(levels):
        ctes += level(f"n{i}", f"n{i + 1}", "k, nokey, ")
    ctes.append(f"r0 AS (SELECT row_number() OVER (ORDER BY nokey DESC, k) - 1 AS kpos, k, nokey, h AS subroot FROM n{levels})")
    ctes.append("m0 AS (SELECT kpos AS pos, subroot AS h FROM r0)")
    for i in range(key_levels):
        ctes += level(f"m{i}", f"m{i + 1}", "")
    step = (
        "CASE WHEN deeper THEN sha256(lft || f || rgt) ELSE f END AS f,"
        " CASE WHEN deeper THEN proof || lft || rgt ELSE proof END AS proof"
    )
    ctes.append("w0 AS (SELECT doc_id, k, nokey, h, kpos, subroot, pos, coalesce(shown, h) AS f, '' AS proof FROM l0 JOIN r0 USING (k, nokey))")
    for i in range(levels):
        ctes.append(f"w{i + 1} AS (SELECT doc_id, k, nokey, h, kpos, subroot, pos // 8 AS pos, {step} FROM w{i} JOIN sn{i} USING (k, nokey, pos))")
    ctes.append(f"v0 AS (SELECT doc_id, h, subroot, kpos AS pos, f, proof FROM w{levels})")
    for i in range(key_levels):
        ctes.append(f"v{i + 1} AS (SELECT doc_id, h, subroot, pos // 8 AS pos, {step} FROM v{i} JOIN sm{i} USING (pos))")
    return (
        "WITH " + ",\n     ".join(ctes) + "\nSELECT doc_id, v.h AS leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256,"
        f" f AS folded_root, f = r.h AS verified FROM v{key_levels} v, m{key_levels} r"
    )


SQL["op12_merkle_manifest"] = _merkle_sql()


@query
def op13_parity_join(spark, d):
    return parity.jaccard_groups(_table(spark, d, "documents"))


SQL["op13_parity_join"] = rf"""
WITH RECURSIVE split AS (SELECT doc_id, list_filter(string_split_regex({_FOLD.format("coalesce(text, '')")}, '[\x20\x09-\x0D]+'),
                                                    lambda w: w <> '') AS words FROM documents),
     shingles AS (SELECT DISTINCT doc_id, array_to_string(words[p:p + 3], ' ') AS s
                  FROM (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 2))) AS p FROM split WHERE len(words) > 0)),
     sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
     shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingles a JOIN shingles b USING (s)
                WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
     links AS (SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y
               WHERE 100 * k >= 85 * (a.n + b.n - k)),
     reach AS (SELECT doc_id, doc_id AS z FROM documents
               UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.z)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM documents d LEFT JOIN sizes USING (doc_id)
     JOIN (SELECT doc_id, min(z) AS component_id FROM reach GROUP BY 1) USING (doc_id)"""
