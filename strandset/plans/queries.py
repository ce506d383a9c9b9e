"""The registered queries on sets of words, with their SQL.

Reads are derived from the whole texts of ``documents``; every query runs over all of them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandset.functions import kmer as K
from strandset.operators import graph, multiset, unionfind
from strandset.operators import spss as P
from strandset.operators import words as W
from strandset.operators.growth import grown_spss
from strandset.operators.lineage import own_folder, settled, written
from strandset.operators.superwords import classes_of_sets, count_super_words, links_by_words, sets_of_words
from strandset.sources import buckets, store
from strandset.sources.reads import LETTER_BASES, LETTERS, load_strings, read_fasta, reads_from_documents, write_strings

SIZE, BUCKET_BITS = 15, 14


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    cores = spark.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() < cores:  # one small file is one task; a large table is split by its scan
        docs = docs.repartition(cores)
    return reads_from_documents(docs)


def _words(spark: SparkSession, sf_dir: str, canonical: bool = True, k: int = SIZE) -> DataFrame:
    """(read_id, set_id, code) of every word."""
    return W.codes(W.fragments(reads(spark, sf_dir)), k, canonical)


def _counts(spark: SparkSession, sf_dir: str, canonical: bool = True, k: int = SIZE) -> DataFrame:
    return count_super_words(W.fragments(reads(spark, sf_dir)), k, canonical)


def _set(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return count_super_words(W.fragments(reads(spark, sf_dir).where(F.col("set_id") == name)), SIZE).select("code")


def _distinct(spark: SparkSession, sf_dir: str, canonical: bool = True) -> DataFrame:
    return _counts(spark, sf_dir, canonical).select("code")


def _spelled(query: Callable[[SparkSession, str], DataFrame], k: int = SIZE) -> Callable[[SparkSession, str], DataFrame]:
    """The query with its codes spelled out, after all else."""
    return lambda s, d: W.spelled(query(s, d), k)


def _scalar(column: Callable[[], Column], name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: W.spelled(_distinct(s, d), SIZE).select("kmer", column().alias(name))


def _bits() -> Column:
    return K.encode(F.col("kmer"))


def _folder(spark: SparkSession) -> str:
    return f"{own_folder(spark)}/query-{uuid.uuid4().hex}"


def _graph_words(spark: SparkSession, sf_dir: str, canonical: bool = True) -> DataFrame:
    return written(_distinct(spark, sf_dir, canonical))


def _stored(spark: SparkSession, words: DataFrame) -> buckets.StoredWords:
    """A stored table of rows without equals."""
    path = _folder(spark)
    buckets.store_words(words, path, SIZE, unlike=True)
    return buckets.open_words(spark, path)


def _two_stored(spark: SparkSession, sf_dir: str) -> tuple[buckets.StoredWords, buckets.StoredWords]:
    return _stored(spark, _set(spark, sf_dir, "src1")), _stored(spark, _set(spark, sf_dir, "src2"))


def _set_counts(spark: SparkSession, sf_dir: str, name: str, k: int = SIZE) -> DataFrame:
    return count_super_words(W.fragments(reads(spark, sf_dir).where(F.col("set_id") == name)), k)


def _by_set(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str | None]]:
    return sets_of_words(W.fragments(rows := reads(spark, sf_dir)), SIZE, named=rows)


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes_of_sets(W.fragments(rows := reads(spark, sf_dir)), SIZE, named=rows)


def _set_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(set_id, code): each set's words once."""
    of_word, names = _by_set(spark, sf_dir)
    numbers = spark.createDataFrame(list(enumerate(names)), "n int, set_id string")
    return of_word.select("code", F.explode("held").alias("n")).join(F.broadcast(numbers), "n").select("set_id", "code")


def _stored_count_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored counter of all reads, to which the counts of one source are added as a batch."""
    own = _stored(spark, _counts(spark, sf_dir))
    buckets.add_batch(spark, own.path, "src1", _set_counts(spark, sf_dir, "src1"))
    return buckets.open_counts(spark, own.path).table


def _components_by_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of ``components`` in three parts: one labelled at once, two merged into its stored labels."""
    pairs = settled(lambda: _shared_source_pairs(spark, sf_dir))
    part = [pairs.where(F.pmod(F.xxhash64("x", "y"), F.lit(3)) == n) for n in range(3)]
    path = _folder(spark)
    unionfind.store_components(graph.components(part[0], reads(spark, sf_dir).select(F.col("read_id").alias("id"))), path)
    for n in (1, 2):
        unionfind.merge_pairs(spark, path, str(n), part[n])
    return unionfind.labels(spark, path)


def _fasta_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads written as FASTA with a header line each, then read, split and counted."""
    path = _folder(spark)
    lines = reads(spark, sf_dir).select(F.concat(F.lit(">"), F.col("read_id").cast("string"), F.lit("\n"), "seq").alias("value"))
    lines.write.option("compression", "gzip").text(path)
    return W.statistics(count_super_words(W.fragments(read_fasta(spark, path)), SIZE).select("code"))


def _spss_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set as strings in text files, loaded and decoded."""
    path = _folder(spark)
    write_strings(P.spss(_distinct(spark, sf_dir), SIZE), path, "gzip")
    return P.words_of(load_strings(spark, path, SIZE), SIZE)


def _set_equals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set against itself and against another."""
    one = _set(spark, sf_dir, "src1")
    rows = [W.difference_size(one, _set(spark, sf_dir, name)).withColumn("other", F.lit(name)) for name in ("src1", "src2")]
    return rows[0].unionByName(rows[1])


def _multiset(spark: SparkSession, sf_dir: str) -> multiset.MultiSet:
    return multiset.compress_strings(W.fragments(rows := reads(spark, sf_dir)), SIZE, BUCKET_BITS, named=rows)


def _multiset_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and hashes of all sets, read back from a stored multi-set."""
    path = _folder(spark)
    store.write_multiset(_multiset(spark, sf_dir), path)
    return W.statistics(store.read_multiset(spark, path).all_sets(), ("set_id",))


def _shared_source_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share a word are linked so that they hang together."""
    return links_by_words(W.fragments(reads(spark, sf_dir).where("read_id IS NOT NULL")), 23, "read_id").distinct()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "set_stat": lambda s, d: W.statistics(W.cut_off(_counts(s, d), 2)),
    "set_stat_by_source": lambda s, d: W.statistics(_set_rows(s, d), ("set_id",)),
    "n_split_fragments": lambda s, d: W.fragments(reads(s, d)).groupBy("read_id").agg(F.count("*").alias("n_frags"), F.sum(F.length("frag")).alias("n_bases")),
    "kmer_count_canonical_k15": _spelled(_counts),
    "kmer_count_canonical_k23": _spelled(lambda s, d: _counts(s, d, k=23), 23),
    "kmer_count_forward": _spelled(lambda s, d: _counts(s, d, False, 9), 9),
    "kmer_count_saturated": _spelled(lambda s, d: _counts(s, d, k=9).where("cnt = 255"), 9),
    "count_cutoff": _spelled(lambda s, d: W.cut_off(_counts(s, d), 4)),
    "count_dropped": lambda s, d: W.n_dropped(_counts(s, d), 4),
    "count_add": _spelled(lambda s, d: W.add_counts(_counts(s, d, k=9), _set_counts(s, d, "src1", 9)), 9),
    "count_get": _spelled(lambda s, d: W.lookup(_set_counts(s, d, "src1"), _set(s, d, "src2"))),
    "kmer_encode": _scalar(_bits, "bits"),
    "kmer_decode": _scalar(lambda: K.decode(_bits(), SIZE), "decoded"),
    "kmer_last": _scalar(lambda: K.last_base(F.col("kmer")), "last_base"),
    "kmer_revcomp": _scalar(lambda: K.reverse_complement(F.col("kmer")), "revcomp"),
    "kmer_canonical": _scalar(lambda: K.canonical(K.reverse_complement(F.col("kmer"))), "canonical"),
    "kmer_next": _scalar(lambda: K.following(F.col("kmer"), "C"), "next_c"),
    "kmer_prev": _scalar(lambda: K.preceding(F.col("kmer"), "C", SIZE), "prev_c"),
    "kmer_nexts": lambda s, d: W.spelled(_distinct(s, d), SIZE).select("kmer", F.explode(K.successors(F.col("kmer"))).alias("next_kmer")),
    "kmer_prevs": lambda s, d: W.spelled(_distinct(s, d), SIZE).select("kmer", F.explode(K.predecessors(F.col("kmer"), SIZE)).alias("prev_kmer")),
    "bucket_key": _spelled(lambda s, d: _distinct(s, d).select("code", K.bucket(F.col("code"), SIZE, BUCKET_BITS).alias("bucket"), K.bucket_key(F.col("code"), SIZE, BUCKET_BITS).alias("key"))),
    "bucket_key_inverse": _scalar(lambda: K.from_bucket(K.bucket(_bits(), SIZE, BUCKET_BITS), K.bucket_key(_bits(), SIZE, BUCKET_BITS), SIZE, BUCKET_BITS), "bits"),
    "sat_add": _spelled(lambda s, d: _counts(s, d, k=9).select("code", K.saturating_add(F.col("cnt"), F.lit(200).cast("long")).alias("cnt")), 9),
    "set_union": _spelled(lambda s, d: W.union(_set(s, d, "src1"), _set(s, d, "src2"))),
    "set_except": _spelled(lambda s, d: W.difference(_set(s, d, "src1"), _set(s, d, "src2"))),
    "set_intersect": _spelled(lambda s, d: W.intersection(_set(s, d, "src1"), _set(s, d, "src2"))),
    "set_symdiff_size": lambda s, d: W.difference_size(_set(s, d, "src1"), _set(s, d, "src2")),
    "set_equals": _set_equals,
    "set_find": lambda s, d: W.find(W.spelled(_distinct(s, d), SIZE), F.col("kmer").startswith("ACG")),
    "set_sample_buckets": _spelled(lambda s, d: W.sampled(_distinct(s, d), SIZE, BUCKET_BITS)),
    "stored_union": _spelled(lambda s, d: buckets.union(*_two_stored(s, d))),
    "stored_intersect": _spelled(lambda s, d: buckets.intersection(*_two_stored(s, d))),
    "stored_difference": _spelled(lambda s, d: buckets.difference(*_two_stored(s, d))),
    "stored_sizes": lambda s, d: buckets.sizes(*_two_stored(s, d)),
    "stored_pair_weights": lambda s, d: W.pair_weights(_stored(s, _set_rows(s, d)).table),
    "stored_count_get": _spelled(lambda s, d: buckets.lookup(_stored(s, _set_counts(s, d, "src1")), _set(s, d, "src2"))),
    "stored_count_add": _spelled(_stored_count_add),
    "pair_weights_full": lambda s, d: W.pairs_of_classes(_classes(s, d)),
    "pair_weights_sampled": lambda s, d: W.pair_weights(W.sampled(_words(s, d).select("set_id", "code"), SIZE, BUCKET_BITS)),
    "colour_classes": lambda s, d: _classes(s, d).select(F.array_join("colour", ",").alias("colour"), "cnt"),
    "degree_by_side": _spelled(lambda s, d: graph.side_degrees(_distinct(s, d), SIZE)),
    "set_contains": _spelled(lambda s, d: W.contains(_set(s, d, "src1"), _set(s, d, "src2"))),
    "terminal_ends": lambda s, d: graph.terminals(_graph_words(s, d), SIZE),
    "terminal_ends_directed": lambda s, d: graph.terminals(_graph_words(s, d, False), SIZE, canonical=False),
    "unitigs_canonical": lambda s, d: graph.unitigs(_distinct(s, d), SIZE),
    "unitigs_directed": lambda s, d: graph.unitigs_directed(_distinct(s, d, False), SIZE),
    "unitigs_to_set": lambda s, d: P.words_of(graph.unitigs(_distinct(s, d), SIZE), SIZE),
    "unitig_stats": lambda s, d: P.string_stats(graph.unitigs(_distinct(s, d), SIZE), SIZE),
    "unitig_overlap_edges": lambda s, d: P.unitig_edges(graph.unitigs(_distinct(s, d), SIZE), SIZE),
    "spss_canonical": lambda s, d: P.spss(_distinct(s, d), SIZE),
    "spss_canonical_shuffled": lambda s, d: P.spss(_distinct(s, d), SIZE, shuffled=True),
    "spss_directed": lambda s, d: P.spss(_distinct(s, d, False), SIZE, canonical=False),
    "spss_directed_to_set": lambda s, d: P.words_of(P.spss(_distinct(s, d, False), SIZE, canonical=False), SIZE, canonical=False),
    "spss_weight": lambda s, d: P.string_stats(P.spss(_distinct(s, d), SIZE), SIZE),
    "spss_canonical_once": lambda s, d: P.held_once(P.spss(words := _graph_words(s, d), SIZE), words, SIZE),
    "spss_shuffled_once": lambda s, d: P.held_once(P.spss(words := _graph_words(s, d), SIZE, shuffled=True), words, SIZE),
    "spss_directed_once": lambda s, d: P.held_once(P.spss(words := _graph_words(s, d, False), SIZE, canonical=False), words, SIZE, canonical=False),
    "spss_grown_once": lambda s, d: P.held_once(grown_spss(words := _graph_words(s, d), SIZE), words, SIZE),
    "spss_grown_directed_once": lambda s, d: P.held_once(grown_spss(words := _graph_words(s, d, False), SIZE, canonical=False), words, SIZE, canonical=False),
    "spss_load_roundtrip": _spss_roundtrip,
    "fasta_roundtrip": _fasta_roundtrip,
    "components": lambda s, d: graph.components(_shared_source_pairs(s, d), reads(s, d).select(F.col("read_id").alias("id"))),
    "components_by_batches": _components_by_batches,
    "multiset_node_sizes": lambda s, d: _multiset(s, d).nodes.groupBy("node_id").agg(F.count("*").alias("size")),
    "multiset_reachable": lambda s, d: _multiset(s, d).reachable(),
    "multiset_get": lambda s, d: _multiset(s, d).get("src1"),
    "multiset_all_sets": _multiset_stored,
    "dot_lines": lambda s, d: store.dot_lines(_multiset(s, d).edges),
    "adjacency_text": lambda s, d: store.adjacency_text(_multiset(s, d).edges),
}

_SPLIT = f"""r AS (SELECT doc_id AS read_id, source AS set_id, regexp_replace(translate(regexp_replace(text, '[^A-Za-zÀ-ɏ]', '', 'g'),
 '{LETTERS}', '{LETTER_BASES}'), '[^ACGT]', 'N', 'g') AS seq FROM documents),
f AS (SELECT * FROM (SELECT read_id, set_id, unnest(string_split(seq, 'N')) AS frag FROM r) WHERE length(frag) > 0)"""


def _rc(s: str) -> str:
    return f"translate(reverse({s}), 'ACGT', 'TGCA')"


def _sql(body: str, k: int = SIZE, canonical: bool = True) -> str:
    word = f"least(w, {_rc('w')})" if canonical else "w"
    return (
        f"WITH RECURSIVE {_SPLIT}, p AS (SELECT read_id, set_id, frag, unnest(range(1, length(frag) - {k} + 2)) AS pos FROM f WHERE length(frag) >= {k}), "
        f"w AS (SELECT read_id, set_id, {word} AS kmer FROM (SELECT read_id, set_id, substring(frag, pos, {k}) AS w FROM p)), "
        f"d AS (SELECT DISTINCT kmer FROM w), c AS (SELECT kmer, least(count(*), 255)::BIGINT AS cnt FROM w GROUP BY kmer), "
        f"a AS (SELECT DISTINCT kmer FROM w WHERE set_id = 'src1'), b AS (SELECT DISTINCT kmer FROM w WHERE set_id = 'src2') {body}"
    )


_BITS = "(" + " + ".join(f"(strpos('ACGT', substring(kmer, {i + 1}, 1)) - 1) * {4 ** (SIZE - 1 - i)}" for i in range(SIZE)) + ")::BIGINT"
_LOW = 2 * SIZE - BUCKET_BITS
BASES = "".join(K.BASES)
_SAMPLE = f"({_BITS}) // {1 << _LOW} % 50 = 7 AND ({_BITS}) // {1 << _LOW} < {50 * (2**BUCKET_BITS // 50)}"


def _pairs(source: str) -> str:
    return f"SELECT x.set_id AS i, y.set_id AS j, count(*)::BIGINT AS weight FROM {source} x JOIN {source} y ON x.kmer = y.kmer AND x.set_id < y.set_id GROUP BY 1, 2"


def _graph_sql(body: str, canonical: bool = True) -> str:
    """``o``: oriented words (s, canonical c, prefix and suffix of one letter less, n: successors that are other words).

    Successors are counted by overlap, less the word's own two orientations, so no self-join is needed.
    """
    oriented = f"SELECT kmer AS s, kmer AS c FROM dm UNION ALL SELECT {_rc('kmer')}, kmer FROM dm" if canonical else "SELECT kmer AS s, kmer AS c FROM dm"
    mine = "(pre = suf)::INT" + (f" + (left({_rc('s')}, {SIZE - 1}) = suf)::INT" if canonical else "")
    return _sql(
        f", dm AS MATERIALIZED (SELECT kmer FROM d), o0 AS MATERIALIZED (SELECT s, c, left(s, {SIZE - 1}) AS pre, right(s, {SIZE - 1}) AS suf FROM ({oriented})), "
        "met AS MATERIALIZED (SELECT pre AS overlap, count(*) AS n FROM o0 GROUP BY pre), "
        f"o AS MATERIALIZED (SELECT s, c, pre, suf, coalesce(n, 0) - ({mine}) AS n FROM o0 LEFT JOIN met ON suf = overlap) {body}",
        canonical=canonical,
    )


_PRE = f"""ins AS MATERIALIZED (SELECT suf AS overlap, count(*) AS n FROM o0 GROUP BY suf),
i AS MATERIALIZED (SELECT s, c, pre, coalesce(ins.n, 0) - ({{mine}}) AS n FROM o0 LEFT JOIN ins ON pre = overlap),
m AS MATERIALIZED (SELECT x.s AS u, y.s AS v FROM o x JOIN i y ON x.suf = y.pre AND x.c <> y.c WHERE x.n = 1 AND y.n = 1)"""


def _links_sql(body: str, canonical: bool = True) -> str:
    """``m``: (u, v) where v is the only successor of u, and u the only predecessor of v."""
    mine = "(pre = suf)::INT" + (f" + (right({_rc('s')}, {SIZE - 1}) = pre)::INT" if canonical else "")
    return _graph_sql(f", {_PRE.format(mine=mine)} {body}", canonical)


#: Strings that hold each word of the set exactly once, none else, and so many letters as their words and overlaps need.
_ONCE = f"SELECT count(*)::BIGINT AS n_words, count(*)::BIGINT AS n_distinct, 0::BIGINT AS n_repeated, 0::BIGINT AS n_missing, 0::BIGINT AS n_foreign, bit_xor({_BITS})::BIGINT AS hash, true AS lengths_agree FROM d"

#: The last table is materialised, so that a LIMIT around the query doesn't change the joins below it.
_TERMINALS = """, ends AS (SELECT u AS kmer, 0 AS v, 1 AS u FROM m UNION ALL SELECT v, 1, 0 FROM m UNION ALL SELECT kmer, 0, 0 FROM dm),
e AS MATERIALIZED (SELECT kmer, max(v) = 0 AS starts, max(u) = 0 AS ends FROM ends GROUP BY kmer),
t AS MATERIALIZED (SELECT e.* FROM e SEMI JOIN dm USING (kmer)) SELECT kmer, starts, ends FROM t"""

#: Doublings of a pointer: paths of up to 2 ** 17 words; a longer one is an error.
_DOUBLINGS = 17


def _unitigs_sql(body: str, canonical: bool = True) -> str:
    """``t``: unitig strings, by pointers doubled along ``m``; of a path and its mirror image one stays.

    What has not met a head then lies on rings. A ring is walked from its smallest word, read as it is; a walk from any other
    word ends at the first smaller one. Rings hold all that is left, or a path was too long.
    """
    start = "p0 AS MATERIALIZED (SELECT o.s, coalesce(m.u, o.s) AS up, (m.u IS NOT NULL)::INT AS dist FROM o LEFT JOIN m ON o.s = m.v)"
    steps = [f"p{i + 1} AS MATERIALIZED (SELECT a.s, b.up, a.dist + b.dist AS dist FROM p{i} a JOIN p{i} b ON a.up = b.s)" for i in range(_DOUBLINGS)]
    left = f"q AS MATERIALIZED (SELECT p.s, c FROM p{_DOUBLINGS} p JOIN m ON p.up = m.v JOIN o ON p.s = o.s)"
    round_ = "around AS MATERIALIZED (SELECT m.u, m.v, q.c FROM m JOIN q ON m.v = q.s)"
    walk = (
        "walk AS (SELECT s AS first, s AS last, s AS seq FROM q WHERE s = c UNION ALL "
        "SELECT first, v, seq || right(v, 1) FROM walk JOIN around ON last = u WHERE c >= first AND v <> first)"
    )
    strings = f"t0 AS (SELECT up || coalesce(string_agg(right(s, 1), '' ORDER BY dist) FILTER (dist > 0), '') AS seq FROM p{_DOUBLINGS} p ANTI JOIN q USING (s) GROUP BY up)"
    first, last = (f"least({w}, {_rc(w)})" for w in (f"left(seq, {SIZE})", f"right(seq, {SIZE})"))
    kept = f"WHERE {first} > {last} OR (length(seq) = {SIZE} AND seq <= {_rc('seq')})" if canonical else ""
    rings = "rings AS MATERIALIZED (SELECT seq FROM walk JOIN around ON last = u AND first = v)"
    whole = f"(SELECT coalesce(sum(length(seq) - {SIZE - 1}), 0) * {2 if canonical else 1} FROM rings) = (SELECT count(*) FROM q)"
    unitig = f"t AS MATERIALIZED (SELECT seq FROM t0 {kept} UNION ALL SELECT CASE WHEN {whole} THEN seq ELSE error('a path is too long') END FROM rings UNION ALL SELECT error('a path is too long') WHERE NOT {whole})"
    return _links_sql(", " + ", ".join([start, *steps, left, round_, walk, strings, rings, unitig]) + " " + body, canonical)


def _multiset_sql(body: str, most: int = 24, gain: float = 0.1) -> str:
    """Compression by up to ``most`` steps spelled out: c, the classes, z, size and state, b, the best pair of each step.

    ``reach`` holds (node, node_id) of all nodes below each node, ``edges`` (parent, child).
    """
    parts = [
        "ids AS MATERIALIZED (SELECT set_id, row_number() OVER (ORDER BY set_id)::INT - 1 AS id FROM (SELECT DISTINCT set_id FROM w))",
        "n0 AS MATERIALIZED (SELECT count(*)::INT AS n0, (count(*) // 8 + 1)::INT AS step FROM ids)",
        f"h AS (SELECT kmer, any_value({_SAMPLE})::INT AS sampled, list_sort(list(DISTINCT id)) AS held FROM w JOIN ids USING (set_id) GROUP BY kmer)",
        "c0 AS MATERIALIZED (SELECT held, count(*) AS cnt, sum(sampled) AS sampled FROM h GROUP BY held)",
        "z0 AS MATERIALIZED (SELECT false AS stop, sum(len(held) * cnt) AS old FROM c0)",
    ]
    for i in range(most):
        size = f"(SELECT sum(len(held) * cnt) FROM c{i})"
        if i:
            test = f"{i} % (SELECT step FROM n0) = 0"
            rule = f"(old - {size})::DOUBLE / old <= {gain} * (SELECT step FROM n0) / (SELECT n0 FROM n0)"
            parts.append(f"z{i} AS MATERIALIZED (SELECT stop OR ({test} AND {rule}) AS stop, CASE WHEN {test} THEN {size} ELSE old END AS old FROM z{i - 1})")
        parts.append(
            f"b{i} AS MATERIALIZED (SELECT j, k, (SELECT n0 FROM n0) + {i} AS n FROM (SELECT j, k, sum(sampled) AS weight FROM (SELECT sampled, j, unnest(held) AS k FROM "
            f"(SELECT sampled, held, unnest(held) AS j FROM c{i})) WHERE j < k GROUP BY j, k) WHERE weight > 0 AND NOT (SELECT stop FROM z{i}) ORDER BY weight DESC, j, k LIMIT 1)"
        )
        both = "list_contains(held, j) AND list_contains(held, k)"
        parts.append(f"c{i + 1} AS MATERIALIZED (SELECT CASE WHEN {both} THEN list_append(list_filter(held, lambda x: x <> j AND x <> k), n) ELSE held END AS held, cnt, sampled FROM c{i} LEFT JOIN b{i} ON true)")
    # One step more is looked at: a compression that goes on is an error.
    parts.append(f"over AS MATERIALIZED (SELECT count(*) AS n FROM (SELECT sampled, j, unnest(held) AS k FROM (SELECT sampled, held, unnest(held) AS j FROM c{most})) WHERE j < k AND sampled > 0 AND (SELECT count(*) FROM b{most - 1}) > 0)")
    splits = " UNION ALL ".join(f"SELECT j, k, CASE WHEN (SELECT n FROM over) = 0 THEN n ELSE error('more steps than are spelled out') END AS n FROM b{i}" for i in range(most))
    parts += [
        f"edges AS MATERIALIZED (SELECT unnest([j, k]) AS parent, n AS child FROM ({splits}))",
        f"nodes AS MATERIALIZED (SELECT unnest(held) AS node_id, cnt FROM c{most})",
        "reach AS (SELECT id AS node, id AS node_id FROM ids UNION SELECT node, child FROM reach JOIN edges ON node_id = parent)",
    ]
    return _sql(", " + ", ".join(parts) + " " + body)


ORACLES: dict[str, str] = {
    "set_stat": _sql(f"SELECT count(*)::BIGINT AS size, coalesce(bit_xor({_BITS}), 0)::BIGINT AS hash FROM c WHERE cnt >= 2"),
    "set_stat_by_source": _sql(f"SELECT set_id, count(*)::BIGINT AS size, bit_xor({_BITS})::BIGINT AS hash FROM (SELECT DISTINCT set_id, kmer FROM w) GROUP BY set_id"),
    "n_split_fragments": _sql("SELECT read_id, count(*)::BIGINT AS n_frags, sum(length(frag))::BIGINT AS n_bases FROM f GROUP BY read_id"),
    "kmer_count_canonical_k15": _sql("SELECT kmer, cnt FROM c"),
    "kmer_count_canonical_k23": _sql("SELECT kmer, cnt FROM c", 23),
    "kmer_count_forward": _sql("SELECT kmer, cnt FROM c", 9, False),
    "kmer_count_saturated": _sql("SELECT kmer, cnt FROM c WHERE cnt = 255", 9),
    "count_cutoff": _sql("SELECT kmer, cnt FROM c WHERE cnt >= 4"),
    "count_dropped": _sql("SELECT count(*) FILTER (cnt < 4)::BIGINT AS n_dropped, count(*) FILTER (cnt >= 4)::BIGINT AS n_kept FROM c"),
    "count_add": _sql("SELECT c.kmer, least(c.cnt + coalesce(o.n, 0), 255)::BIGINT AS cnt FROM c LEFT JOIN (SELECT kmer, least(count(*), 255) AS n FROM w WHERE set_id = 'src1' GROUP BY kmer) o ON c.kmer = o.kmer", 9),
    "count_get": _sql("SELECT b.kmer, coalesce(o.n, 0)::BIGINT AS cnt FROM b LEFT JOIN (SELECT kmer, least(count(*), 255) AS n FROM w WHERE set_id = 'src1' GROUP BY kmer) o ON b.kmer = o.kmer"),
    "kmer_encode": _sql(f"SELECT kmer, {_BITS} AS bits FROM d"),
    "kmer_decode": _sql(f", n AS (SELECT kmer, {_BITS} AS bits FROM d) SELECT kmer, {' || '.join(f'substring({BASES!r}, (bits // {4 ** i} % 4 + 1)::INT, 1)' for i in reversed(range(SIZE)))} AS decoded FROM n"),
    "kmer_last": _sql("SELECT kmer, right(kmer, 1) AS last_base FROM d"),
    "kmer_revcomp": _sql(f"SELECT kmer, {_rc('kmer')} AS revcomp FROM d"),
    "kmer_canonical": _sql(f", n AS (SELECT kmer, {_rc('kmer')} AS m FROM d) SELECT kmer, least(m, {_rc('m')}) AS canonical FROM n"),
    "kmer_next": _sql("SELECT kmer, substring(kmer, 2) || 'C' AS next_c FROM d"),
    "kmer_prev": _sql(f"SELECT kmer, 'C' || left(kmer, {SIZE - 1}) AS prev_c FROM d"),
    "kmer_nexts": _sql("SELECT kmer, substring(kmer, 2) || unnest(['A', 'C', 'G', 'T']) AS next_kmer FROM d"),
    "kmer_prevs": _sql(f"SELECT kmer, unnest(['A', 'C', 'G', 'T']) || left(kmer, {SIZE - 1}) AS prev_kmer FROM d"),
    "bucket_key": _sql(f"SELECT kmer, ({_BITS}) // {1 << _LOW} AS bucket, ({_BITS}) % {1 << _LOW} AS key FROM d"),
    "bucket_key_inverse": _sql(f", n AS (SELECT kmer, ({_BITS}) // {1 << _LOW} AS bucket, ({_BITS}) % {1 << _LOW} AS key FROM d) SELECT kmer, (bucket * {1 << _LOW} + key)::BIGINT AS bits FROM n"),
    "sat_add": _sql("SELECT kmer, least(cnt + 200, 255)::BIGINT AS cnt FROM c", 9),
    "set_union": _sql("SELECT kmer FROM a UNION SELECT kmer FROM b"),
    "set_except": _sql("SELECT kmer FROM a EXCEPT SELECT kmer FROM b"),
    "set_intersect": _sql("SELECT kmer FROM a INTERSECT SELECT kmer FROM b"),
    "set_symdiff_size": _sql("SELECT count(*)::BIGINT AS n_diff, count(*) = 0 AS equal FROM a FULL JOIN b ON a.kmer = b.kmer WHERE a.kmer IS NULL OR b.kmer IS NULL"),
    "set_equals": _sql(", ".join(["", *(f"{t}{n} AS (SELECT count(*)::BIGINT AS n_diff, count(*) = 0 AS equal, '{n}' AS other FROM a FULL JOIN {t} q ON a.kmer = q.kmer WHERE a.kmer IS NULL OR q.kmer IS NULL)" for t, n in (("a", "src1"), ("b", "src2")))]) + " SELECT * FROM asrc1 UNION ALL SELECT * FROM bsrc2"),
    "set_find": _sql("SELECT kmer FROM d WHERE kmer LIKE 'ACG%'"),
    "set_sample_buckets": _sql(f"SELECT kmer FROM d WHERE {_SAMPLE}"),
    "stored_union": _sql("SELECT kmer FROM a UNION SELECT kmer FROM b"),
    "stored_intersect": _sql("SELECT kmer FROM a INTERSECT SELECT kmer FROM b"),
    "stored_difference": _sql("SELECT kmer FROM a EXCEPT SELECT kmer FROM b"),
    "stored_sizes": _sql("SELECT n_a, n_b, n_both, n_a + n_b - 2 * n_both AS n_diff, n_a = n_both AND n_b = n_both AS equal FROM (SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM (SELECT kmer FROM a INTERSECT SELECT kmer FROM b)) AS n_both)"),
    "stored_pair_weights": _sql(f", u AS (SELECT DISTINCT set_id, kmer FROM w) {_pairs('u')}"),
    "stored_count_get": _sql("SELECT b.kmer, coalesce(o.n, 0)::BIGINT AS cnt FROM b LEFT JOIN (SELECT kmer, least(count(*), 255) AS n FROM w WHERE set_id = 'src1' GROUP BY kmer) o ON b.kmer = o.kmer"),
    "stored_count_add": _sql("SELECT c.kmer, least(c.cnt + coalesce(o.n, 0), 255)::BIGINT AS cnt FROM c LEFT JOIN (SELECT kmer, least(count(*), 255) AS n FROM w WHERE set_id = 'src1' GROUP BY kmer) o ON c.kmer = o.kmer"),
    "pair_weights_full": _sql(f", u AS (SELECT DISTINCT set_id, kmer FROM w) {_pairs('u')}"),
    "pair_weights_sampled": _sql(f", u AS (SELECT DISTINCT set_id, kmer FROM w WHERE {_SAMPLE}) {_pairs('u')}"),
    "colour_classes": _sql("SELECT colour, count(*)::BIGINT AS cnt FROM (SELECT kmer, string_agg(DISTINCT set_id, ',' ORDER BY set_id) AS colour FROM w GROUP BY kmer) GROUP BY colour"),
    "set_contains": _sql("SELECT kmer, kmer IN (SELECT kmer FROM a) AS contained FROM b"),
    "fasta_roundtrip": _sql(f"SELECT count(*)::BIGINT AS size, bit_xor({_BITS})::BIGINT AS hash FROM d"),
    "unitigs_to_set": _sql("SELECT kmer FROM d"),
    "spss_load_roundtrip": _sql("SELECT kmer FROM d"),
    "spss_directed_to_set": _sql("SELECT kmer FROM d", canonical=False),
    "multiset_get": _sql("SELECT kmer FROM a"),
    "multiset_all_sets": _sql(f"SELECT set_id, count(*)::BIGINT AS size, bit_xor({_BITS})::BIGINT AS hash FROM (SELECT DISTINCT set_id, kmer FROM w) GROUP BY set_id"),
    "unitigs_canonical": _unitigs_sql("SELECT seq FROM t"),
    "unitigs_directed": _unitigs_sql("SELECT seq FROM t", False),
    "unitig_stats": _unitigs_sql(f"SELECT count(*)::BIGINT AS n_strings, sum(length(seq) - {SIZE - 1})::BIGINT AS n_words, sum(length(seq))::BIGINT AS weight FROM t"),
    "unitig_overlap_edges": _unitigs_sql(
        f", z AS MATERIALIZED (SELECT x.*, left(t, {SIZE - 1}) AS pre, right(t, {SIZE - 1}) AS suf FROM (SELECT seq AS t, seq AS n FROM t UNION ALL SELECT {_rc('seq')}, seq FROM t) x) "
        ", pairs AS MATERIALIZED (SELECT x.t AS u, y.t AS v FROM z x JOIN z y ON x.suf = y.pre AND x.n <> y.n) SELECT u, v FROM pairs"
    ),
    "spss_canonical_once": _sql(_ONCE),
    "spss_shuffled_once": _sql(_ONCE),
    "spss_directed_once": _sql(_ONCE, canonical=False),
    "spss_grown_once": _sql(_ONCE),
    "spss_grown_directed_once": _sql(_ONCE, canonical=False),
    "components": _sql(
        ", dw AS MATERIALIZED (SELECT DISTINCT kmer, read_id FROM w), fst AS MATERIALIZED (SELECT kmer, min(read_id) AS x FROM dw GROUP BY kmer), "
        "g AS MATERIALIZED (SELECT DISTINCT x, read_id AS y FROM dw JOIN fst USING (kmer) WHERE x <> read_id), "
        "near AS MATERIALIZED (SELECT x, y FROM g UNION SELECT y, x FROM g), "
        "reach AS (SELECT x AS a, y AS c FROM near UNION SELECT reach.a, near.y FROM reach JOIN near ON reach.c = near.x) "
        "SELECT r.read_id AS id, least(r.read_id, coalesce(min(c), r.read_id))::BIGINT AS component FROM r LEFT JOIN reach ON r.read_id = reach.a GROUP BY r.read_id",
        23,
    ),
    "components_by_batches": _sql(
        ", dw AS MATERIALIZED (SELECT DISTINCT kmer, read_id FROM w), fst AS MATERIALIZED (SELECT kmer, min(read_id) AS x FROM dw GROUP BY kmer), "
        "g AS MATERIALIZED (SELECT DISTINCT x, read_id AS y FROM dw JOIN fst USING (kmer) WHERE x <> read_id), "
        "near AS MATERIALIZED (SELECT x, y FROM g UNION SELECT y, x FROM g), "
        "reach AS (SELECT x AS a, y AS c FROM near UNION SELECT reach.a, near.y FROM reach JOIN near ON reach.c = near.x) "
        "SELECT r.read_id AS id, least(r.read_id, coalesce(min(c), r.read_id))::BIGINT AS component FROM r LEFT JOIN reach ON r.read_id = reach.a GROUP BY r.read_id",
        23,
    ),
    "multiset_node_sizes": _multiset_sql("SELECT node_id, sum(cnt)::BIGINT AS size FROM nodes GROUP BY node_id"),
    "multiset_reachable": _multiset_sql("SELECT set_id, node_id FROM reach JOIN ids ON node = id"),
    "dot_lines": _multiset_sql("SELECT 0 AS pos, 'digraph G {' AS line UNION ALL SELECT 2, '}' UNION ALL SELECT 1, 'v' || parent || ' -> v' || child FROM edges"),
    "adjacency_text": _multiset_sql(
        "SELECT count(*) || coalesce(' ' || string_agg(line, ' ' ORDER BY parent), '') AS text FROM (SELECT parent, parent || ' ' || count(*) || ' ' || string_agg(child, ' ' ORDER BY child) AS line FROM edges GROUP BY parent)"
    ),
    "terminal_ends": _links_sql(_TERMINALS),
    "terminal_ends_directed": _links_sql(_TERMINALS, False),
    "degree_by_side": _graph_sql(
        # A word's successors are counted in its own row, its predecessors as successors of its mirror image.
        ", t AS MATERIALIZED (SELECT c AS kmer, max(CASE WHEN s = c THEN n END)::BIGINT AS right, max(CASE WHEN s <> c THEN n END)::BIGINT AS left FROM o GROUP BY c) SELECT * FROM t"
    ),
}
