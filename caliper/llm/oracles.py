"""SQL with the same results as the operators that SQL can express, for DuckDB."""

from __future__ import annotations

from caliper.llm.sharding import Leaf, uniform_tree

#: crc32 of bytes, by its table: entry i is i shifted right eight times, each carry folding the reversed polynomial.
_CRC = """crc_table AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS tab FROM range(256) r(i)),
crc AS (SELECT DISTINCT text, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS value FROM documents, crc_table)"""


def _race(keys: str, tree: list[tuple[str, int, int, float]]) -> str:
    """For each (k, parent) of keys the child with the smallest weighted draw. tree: (path, parent, child, weight)."""
    rows = ", ".join(f"('{path}', {parent}, {child}, {weight}::DOUBLE)" for path, parent, child, weight in tree)
    return f"""SELECT k, arg_min(child, (-ln((CAST('0x' || substr(md5(k || '|' || path), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / weight, child)) AS child
    FROM ({keys}) JOIN (VALUES {rows}) v(path, parent, child, weight) USING (parent) GROUP BY k"""


def _levels(name: str, tree: list[Leaf]) -> str:
    regions: dict[int, float] = {}
    racks: dict[tuple[int, int], float] = {}
    for x in tree:
        regions[x.region] = regions.get(x.region, 0.0) + x.weight
        racks[x.region, x.rack] = racks.get((x.region, x.rack), 0.0) + x.weight
    r = _race("SELECT k, 0 AS parent FROM keys", [(f"0/region/{i}", 0, i, w) for i, w in regions.items()])
    k = _race(f"SELECT k, child AS parent FROM {name}_region", [(f"{i}/rack/{j}", i, j, w) for (i, j), w in racks.items()])
    s = _race(f"SELECT k, child AS parent FROM {name}_rack", [(f"{x.rack}/shard/{x.shard}", x.rack, x.shard, x.weight) for x in tree])
    return f"{name}_region AS ({r}), {name}_rack AS ({k}), {name} AS ({s})"


def hash_tree_shards() -> str:
    return f"""WITH {_CRC}, keys AS (SELECT DISTINCT coalesce(doc_id::VARCHAR, '') AS k FROM documents), {_levels("now", uniform_tree(24))}, {_levels("grown", uniform_tree(25))},
    placed AS (SELECT doc_id, coalesce(octet_length(encode(d.text)), 0) + 8 AS size, crc.value AS text_crc32, now.child AS shard, grown.child AS grown_shard, now_region.child AS region, now_rack.child AS rack, k
      FROM documents d LEFT JOIN crc ON crc.text = d.text JOIN now ON now.k = coalesce(doc_id::VARCHAR, '') JOIN grown USING (k) JOIN now_region USING (k) JOIN now_rack USING (k)),
    cut AS (SELECT greatest(1, CAST(floor(sqrt(count(*) / count(DISTINCT shard)::DOUBLE)) AS BIGINT)) AS buckets FROM placed)
    SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY CAST('0x' || substr(md5('slot|' || k), 1, 7) AS BIGINT) % buckets, doc_id NULLS LAST, size, text_crc32 NULLS LAST) - 1 AS slot, grown_shard, region, rack
    FROM placed, cut"""


#: Exact links between all documents that share a shingle, and the smallest id that each reaches.
MINHASH_DEDUP = """WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, least(len(w), 1)) + 1)) AS i FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b USING (s) JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id WHERE a.doc_id <> b.doc_id AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, d.doc_id = c AS kept FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id JOIN (SELECT a, min(b) AS c FROM reach GROUP BY 1) ON a = d.doc_id"""


#: The pages of the tables follow one template, which regular expressions can take apart; other pages need a parser.
LINE_BLOCK_HTML = r"""WITH body AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1), '<[^>]*$', '') AS b FROM pages),
blocks AS (SELECT page_id, url, list_transform(regexp_split_to_array(replace(b, '<br>', ' '), '</?(?:p|h1)>'), lambda x:
  trim(regexp_replace(regexp_replace(replace(replace(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS l FROM body),
texts AS (SELECT page_id, url, array_to_string(list_filter(l, lambda x: x <> ''), chr(10) || chr(10)) AS t FROM blocks)
SELECT page_id, url, t AS text, length(t) AS n_chars FROM texts"""


#: Nodes are lists of turns; each is joined with what stands above it.
CONVERSATION_TRIE = f"""WITH {_CRC[: _CRC.index("crc AS")].rstrip().rstrip(",")},
own AS (SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
heads AS (SELECT conv_id, own, conv_id - conv_id % 100 AS first, CAST(xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode(conv_id::VARCHAR)), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 6 AS BIGINT) AS h FROM own, crc_table),
rebuilt AS (SELECT c.conv_id, list_concat(list_slice(coalesce(f.own, []), 1, h), list_slice(c.own, h + 1, len(c.own))) AS r FROM heads c LEFT JOIN own f ON f.conv_id = c.first),
members AS (SELECT conv_id, d, len(r) = d AS ends, CASE WHEN d = 0 THEN 0 ELSE length(r[d].t) END AS n, md5(to_json(list_slice(r, 1, d))::VARCHAR) AS node FROM (SELECT conv_id, r, unnest(range(0, len(r) + 1)) AS d FROM rebuilt)),
nodes AS (SELECT node, d, min(conv_id) AS conv_id, count(*) AS c, min(n) AS n, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends FROM members GROUP BY node, d),
up AS (SELECT x.node, x.d, p.node AS parent, p.conv_id AS parent_id FROM nodes x JOIN members m ON m.conv_id = x.conv_id AND m.d = x.d - 1 JOIN nodes p ON p.node = m.node AND p.d = m.d),
kids AS (SELECT parent AS node, d - 1 AS d, count(*) AS k FROM up GROUP BY 1, 2),
sums AS (SELECT a.node, a.d, count(*) FILTER (kids.k IS NULL) AS leaves, sum((x.c - 1) * x.n) AS saved FROM nodes x JOIN members a ON a.conv_id = x.conv_id AND a.d <= x.d LEFT JOIN kids ON kids.node = x.node AND kids.d = x.d GROUP BY a.node, a.d)
SELECT x.conv_id, x.d AS depth, up.parent_id AS parent_conv_id, x.c AS n_convs, coalesce(kids.k, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends AS ends_sha256
FROM nodes x JOIN sums ON sums.node = x.node AND sums.d = x.d LEFT JOIN up ON up.node = x.node AND up.d = x.d LEFT JOIN kids ON kids.node = x.node AND kids.d = x.d"""


def heap_lloyd_codes(width: int = 4, parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Every part against every entry, in integers; for vectors of parts * width components."""
    at = lambda i: f"CAST(floor(embedding[p * {width} + {i + 1}]::DOUBLE * 256) AS BIGINT) AS x{i}"
    steps = [
        f"""kept AS (SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id) AS rn FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT rn, p, {", ".join(at(i) for i in range(width))} FROM kept, range({parts}) t(p)),
b0 AS MATERIALIZED (SELECT p, rn - 1 AS e, {", ".join(f"x{i} AS c{i}" for i in range(width))} FROM parts WHERE rn <= {entries})"""
    ]
    gap = " + ".join(f"(x{i} - c{i}) * (x{i} - c{i})" for i in range(width))
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT rn, p, min(({gap}) * {entries} + e) AS best FROM parts JOIN b{r} USING (p) GROUP BY rn, p)")
        if r < rounds:
            means = ", ".join(f"coalesce(m{i}, c{i}) AS c{i}" for i in range(width))
            sums = ", ".join(f"CAST(floor(sum(x{i})::DOUBLE / count(*)) AS BIGINT) AS m{i}" for i in range(width))
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, {means} FROM b{r} b LEFT JOIN (SELECT p, best % {entries} AS e, {sums} FROM parts JOIN a{r} USING (rn, p) GROUP BY 1, 2) m ON m.p = b.p AND m.e = b.e)")
    flat = " || ',' || ".join(f"c{i}::VARCHAR" for i in range(width))
    return f"""WITH {", ".join(steps)},
coded AS (SELECT rn, string_agg(printf('%02x', best % {entries}), '' ORDER BY p) AS code, CAST(sum(best // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY rn),
rows AS (SELECT vec_id, label, code, error FROM kept JOIN coded USING (rn))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg({flat}, ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256 FROM rows"""
