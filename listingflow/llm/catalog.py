"""The registered queries of the operators, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listingflow.llm import (
    ann, bpe, conversation_trie, language_id, line_dedup, mixing, quality_rules, sharding, simhash, token_counts, url_filter, warc,
    whitening,
)
from listingflow.llm.common import read_table, stored

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its later repeated runs of lines taken out."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", F.col("text").alias("whole"))
    runs = F.array_join(F.transform("removed_runs", lambda r: F.concat_ws("-", r["start"], r["stop"])), ",")
    kept = line_dedup.dedup_lines(docs)
    return kept.select(
        "doc_id", F.size("removed_runs").cast("long").alias("n_runs"), runs.alias("removed_runs"),
        (F.char_length("whole") - F.char_length("text")).cast("long").alias("removed_chars"), "text")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL under the rules and the language models."""
    return url_filter.judge(read_table(spark, sf_dir, "pages"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document."""
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored rule ledger of every document under all policies, and what leaving out its only failed rule would bring back."""
    entries = stored(quality_rules.ledger(read_table(spark, sf_dir, "documents")), "ledger")
    return quality_rules.judged(entries).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed",
        "kept_base", "kept_v1", "sole_rule", "brought_back")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as WARC and read back, in the order of the merged index."""
    return warc.archive(read_table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mixing.mix(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken",
        F.array_join(F.col("shards").cast("array<string>"), ",").alias("shards"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the same table."""
    return language_id.identify(read_table(spark, sf_dir, "documents"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors of every hundredth vector among all."""
    return ann.nearest(read_table(spark, sf_dir, "embeddings"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    return bpe.round_trip(read_table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    return conversation_trie.trie(read_table(spark, sf_dir, "conversations"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector on the components that whiten all of them."""
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in a shard, by the slot map edited for the bytes found."""
    return sharding.shard(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_line_dedup, op2_url_filter, op3_token_counts, op4_simhash, op5_quality_rules, op6_warc, op7_mixing,
    op8_language_id, op9_ann, op10_bpe, op11_conversation_trie, op12_whitening, op13_sharding)}

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE: dict[str, str] = {
    "op1_line_dedup": f"""
with cut as (select doc_id, text, string_split(text, chr(10)) as parts from documents),
raw as (select doc_id, unnest(parts) as line, unnest(range(len(parts))) as pos from cut),
lines as (select doc_id, pos, trim(line, {_BLANKS}) as line,
                 len(regexp_split_to_array(trim(line, {_BLANKS}), '[\\x20\\x09-\\x0D]+')) as words
          from raw where trim(line, {_BLANKS}) <> ''),
placed as (select *, row_number() over (partition by doc_id order by pos) as nth from lines),
pairs as (select a.doc_id, a.nth, a.pos, a.words, b.doc_id as other, a.nth - b.nth as shift
          from placed a join placed b on a.line = b.line and (b.doc_id < a.doc_id or b.doc_id = a.doc_id and b.nth < a.nth)),
chained as (select *, nth - row_number() over (partition by doc_id, other, shift order by nth) as chain from pairs),
weighed as (select *, sum(words) over (partition by doc_id, other, shift, chain) as run_words from chained),
repeats as (select distinct doc_id, nth, pos from weighed where run_words >= 50),
numbered as (select *, nth - row_number() over (partition by doc_id order by nth) as island from repeats),
islands as (select doc_id, island, min(pos) as start, max(pos) as stop from numbered group by doc_id, island),
gone as (select doc_id, count(*) as n_runs, string_agg(start || '-' || stop, ',' order by start) as removed_runs
         from islands group by doc_id),
kept as (select r.doc_id, string_agg(r.line, chr(10) order by r.pos) as text from raw r
         where not exists (select 1 from islands i where i.doc_id = r.doc_id and r.pos between i.start and i.stop)
         group by r.doc_id)
select d.doc_id, coalesce(g.n_runs, 0)::bigint as n_runs, coalesce(g.removed_runs, '') as removed_runs,
       (length(d.text) - length(case when d.text is not null then coalesce(k.text, '') end))::bigint as removed_chars,
       case when d.text is not null then coalesce(k.text, '') end as text
from documents d left join gone g using (doc_id) left join kept k using (doc_id)""",
    "op5_quality_rules": f"""
with split as (select doc_id, coalesce(text, '') as text,
                      list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as words,
                      list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: trim(l, {_BLANKS}) <> '') as lines
               from documents),
placed as (select doc_id, unnest(words) as word, unnest(range(len(words))) as pos from split),
grams as (select doc_id, pos, string_agg(word, ' ') over w as gram, count(*) over w as n
          from placed window w as (partition by doc_id order by pos rows between current row and 4 following)),
twice as (select doc_id, pos from (select doc_id, pos, count(*) over (partition by doc_id, gram) as k from grams where n = 5)
          where k > 1),
covered as (select doc_id, sum(least(5, coalesce(following - pos, 5)))::bigint as n_repeat_words
            from (select doc_id, pos, lead(pos) over (partition by doc_id order by pos) as following from twice)
            group by doc_id),
joined as (select s.doc_id, array_to_string(words, '') as joined, len(words) as n_words, len(lines) as n_lines,
                  len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(c.n_repeat_words, 0) as n_repeat_words
           from split s left join covered c using (doc_id)),
measured as (select doc_id, n_words, length(joined) as word_chars, n_lines, n_dup_lines, n_repeat_words,
                    len(regexp_extract_all(joined, '[#*$%&|<>]')) as n_symbols,
                    length(regexp_replace(joined, '\\P{{Lu}}+', '', 'g')) as n_upper,
                    length(regexp_replace(joined, '\\P{{L}}+', '', 'g')) as n_letters from joined),
judged as (select *, n_words < 10 as r0, 100 * n_repeat_words > 20 * n_words as r1, 10 * n_symbols > n_words as r2,
                  n_dup_lines > 5 and 10 * n_dup_lines > 3 * n_lines as r3, word_chars < 2 * n_words as r4,
                  word_chars > 15 * n_words as r5, 2 * n_upper > word_chars as r6,
                  2 * n_letters < word_chars as r7 from measured),
told as (select *, case when r0::int + r1::int + r2::int + r3::int + r4::int + r5::int + r6::int + r7::int = 1 then
                    case when r0 then 'few_words' when r1 then 'repeated_words' when r2 then 'symbols' when r3 then 'duplicate_lines'
                         when r4 then 'short_words' when r5 then 'long_words' when r6 then 'shouting' else 'few_letters' end end as sole_rule
         from judged)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
       n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, r0 or r1 as base_failed,
       not (r0 or r1 or r2 or r3 or r4 or r5 or r6 or r7) as kept,
       (r0::int + 2 * r1::int + 4 * r2::int + 8 * r3::int + 16 * r4::int + 32 * r5::int + 64 * r6::int
        + 128 * r7::int)::bigint as failed,
       not (r0 or r1) as kept_base, not (r0 or r1 or r2 or r3) as kept_v1, sole_rule,
       case when sole_rule is not null then count(*) over (partition by sole_rule) end as brought_back
from told""",
    "op6_warc": """
with read as (select page_id, url, sha256(coalesce(html, '')) as digest, strlen(coalesce(html, ''))::bigint as n from pages),
firsts as (select digest, min(page_id) as first_id, count(*) as copies from read where n >= 100 group by digest),
parts as (select r.*, case when f.copies > 1 and r.page_id > f.first_id then f.first_id end as origin,
                 regexp_replace(r.url, '[\\x00-\\x20\\x7f]', '%20', 'g') as uri from read r left join firsts f using (digest))
select page_id, n as payload_bytes, digest as payload_digest,
       case when origin is null then 'response' else 'revisit' end as record_type, origin as refers_to,
       case when position('://' in uri) > 0
            then array_to_string(list_reverse(string_split(lower(regexp_extract(uri, '://([^/?#]*)', 1)), '.')), ',') || ')'
                 || regexp_extract(uri, '://[^/?#]*(.*)$', 1)
            else coalesce(uri, '') end as url_key,
       strftime(timestamp '2024-01-01 00:00:00' + to_seconds(page_id), '%Y-%m-%dT%H:%M:%SZ') as captured_at
from parts""",    "op11_conversation_trie": """
with plain as (select conv_id as c, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
               where conv_id is not null),
turns as (select c, words, digest, row_number() over (partition by c order by turn nulls first, digest) as place
          from (select c, turn, substr(sha256(length(role) || ':' || role || text), 1, 32) as digest,
                       len(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) as words from plain)),
sizes as (select c, count(*) as n from turns group by c),
skips as (select c, c - c % 20 as base, xor(list_reduce(
              list_prepend(4294967295::bigint, list_transform(string_split(c::varchar, ''), lambda x: ord(x)::bigint)),
              lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
                  lambda v, z: case when v & 1 = 1 then xor(v >> 1, 3988292384::bigint) else v >> 1 end)), 4294967295::bigint) % 4 as h
          from sizes),
rebuilt as (select t.c, t.place - s.h + least(s.h, coalesce(b.n, 0)) as pos, t.digest, t.words
            from turns t join skips s using (c) left join sizes b on b.c = s.base where t.place > s.h
            union all select s.c, t.place, t.digest, t.words from skips s join turns t on t.c = s.base and t.place <= s.h),
prefixes as (select c, pos as depth, words, sha256(string_agg(digest, '') over (partition by c order by pos)) as node from rebuilt
             union all select c, 0, 0, '' from sizes),
nodes as (select depth, node, min(c) as conv_id, count(*) as n_convs, (count(*) - 1) * any_value(words) as saved
          from prefixes group by depth, node),
above as (select n.depth, n.node, u.node as parent, u.conv_id as parent_conv_id from nodes n
          join prefixes p on p.c = n.conv_id and p.depth = n.depth - 1 join nodes u on u.depth = p.depth and u.node = p.node),
kids as (select depth - 1 as depth, parent as node, count(*) as n from above group by all),
totals as (select p.depth, p.node, sum(n.saved) as saved, count(*) filter (where k.n is null) as leaves
           from nodes n join prefixes p on p.c = n.conv_id and p.depth <= n.depth
           left join kids k on k.depth = n.depth and k.node = n.node group by p.depth, p.node),
ends as (select depth, node, string_agg(c::varchar, ',' order by c) as members
         from prefixes p where depth = (select max(depth) from prefixes q where q.c = p.c) group by depth, node)
select n.conv_id, n.depth::bigint as depth, a.parent_conv_id, n.n_convs, coalesce(k.n, 0)::bigint as n_children,
       t.leaves::bigint as n_leaves, t.saved::bigint as saved_tokens, sha256(coalesce(e.members, '')) as ends_sha256
from nodes n left join above a using (depth, node) left join kids k using (depth, node) join totals t using (depth, node)
left join ends e using (depth, node)""",
}
