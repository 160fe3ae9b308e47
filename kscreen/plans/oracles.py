"""DuckDB SQL for the queries of ``queries``."""

from __future__ import annotations

from kscreen.functions import params
from kscreen.functions.significance import COEFFICIENTS, P
from kscreen.plans.queries import K, SIZING, THRESHOLD, THRESHOLDS, TILE

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LOWER = _FOLD.format("text")
_RC = "translate(reverse({}), 'ACGTacgt', 'TGCAtgca')"


def _tiles(table: str = "documents", cols: str = "doc_id", extra: str = "") -> str:
    """Tiles; the last one may be short."""
    return f"""select {cols}, t as tile_no, substr(s, t * {TILE} + 1, {TILE}) as seq
        from (select *, {_LOWER} as s, unnest(range(0, (length(text) + {TILE - 1}) // {TILE})) as t from {table}{extra})"""


def _windows(source: str, cols: str = "doc_id, tile_no", seq: str = "seq") -> str:
    return f"select {cols}, p as pos, n, substr(seq, p + 1, {K}) as kmer from (select *, length(seq) as n, unnest(range(0, length(seq) - {K - 1})) as p from {source})"


def _ref(cols: str = "") -> str:
    return f"select distinct {cols} substr(s, i, {K}) as kmer from (select *, {_LOWER} as s, unnest(range(1, length(text) - {K} + 2)) as i from benchmark)"


def _strand(name: str, source: str, key: str = "doc_id, tile_no", ref: str = "ref", extra: str = "") -> str:
    """STRAND columns by lag over matching windows."""
    return f"""{name}_w as ({_windows(source)}),
    {name}_h as (select w.*{extra} from {name}_w w join {ref} using (kmer)),
    {name} as (select {key}, count(*) as m,
        count(*) filter (where before is null or pos <> before + 1) as runs, count(distinct pos // {K}) as blocks,
        count(*) filter (where pos % {K} = 0 or pos = n - {K}) as anchor_hits
        from (select *, lag(pos) over (partition by {key} order by pos) as before from {name}_h) group by {key})"""


def _score(m: str, runs: str, n: str) -> str:
    return f"case when {n} >= {K} then cast(cast({K + 1} * {m} + {K - 1} * {runs} as double) / cast({K + 1} * {n} - {K * K} as double) as float) end"


def _verdicts(reads: str, keep: str = "", both: bool = True) -> str:
    """ctes up to v: every read with its counts and verdict."""
    fwd = f"coalesce(f.anchor_hits > 0 and {_score('f.m', 'f.runs', 'length(t.seq)')} >= cast({THRESHOLD} as float), false)"
    rev = f"coalesce(r.anchor_hits > 0 and {_score('r.m', 'r.runs', 'length(t.seq)')} >= cast({THRESHOLD} as float), false)"
    return f"""with ref as ({_ref()}), tiles as ({reads}),
    turned as (select * replace ({_RC.format("seq")} as seq) from tiles),
    {_strand("f0", "tiles")}, {_strand("r0", "turned")},
    v as (select doc_id, tile_no, t.seq, length(t.seq) as read_len, {keep} coalesce(f.m, 0) as fwd_m, coalesce(f.runs, 0) as fwd_runs, coalesce(f.blocks, 0) as fwd_blocks,
        coalesce(f.anchor_hits, 0) > 0 as fwd_gate, {_score("coalesce(f.m, 0)", "coalesce(f.runs, 0)", "length(t.seq)")} as fwd_score,
        {fwd} as fwd_pass, not {fwd} and {rev} as rev_pass, {fwd} or {rev} as contaminated,
        (case when f.anchor_hits > 0 then f.m else 0 end) + (case when {fwd} then 0 when {rev} then 1 else coalesce(r.anchor_hits, 0) end) * coalesce(r.m, 0) as hits
        from tiles t left join f0 f using (doc_id, tile_no) left join r0 r using (doc_id, tile_no))"""


def _p_value(hits: str, bases: str) -> str:
    p = params.default_hit_probability(K)
    x = f"((cast({hits} as double) - {bases} * {p}) / ({bases} * {p} * (1.0 - {p}) * sqrt(2.0)))"
    y = f"(1.0 / (1.0 + {P} * {x}))"
    poly = str(COEFFICIENTS[-1])
    for c in COEFFICIENTS[-2::-1]:
        poly = f"({poly} * {y} + ({c}))"
    return f"case when {bases} > 0 then round(0.5 * (1.0 + (1.0 - {poly} * {y} * exp(-{x} * {x}))), 9) end"


_TOTALS = "count(*) as total_read_count, count(*) filter (where contaminated) as contaminated_reads, cast(coalesce(sum(hits), 0) as bigint) as total_hits, cast(coalesce(sum(read_len), 0) as bigint) as all_k"


def _rates(sums: str, by: str = "") -> str:
    rate = "round(cast(case when total_read_count = 0 then 'nan'::float else cast(cast(contaminated_reads as double) / total_read_count as float) end as double), 9)"
    return f"select {by} total_read_count, contaminated_reads, total_hits, all_k, {rate} as contamination_rate, {_p_value('total_hits', 'all_k')} as p_value from ({sums})"


def _report(reads: str) -> str:
    return f"{_verdicts(reads)} {_rates(f'select {_TOTALS} from v')}"


_BUCKET = "cast('0x' || substr(md5(concat_ws(':', doc_id, tile_no)), 1, 9) as bigint) % 10"
_PLACE = "cast('0x' || substr(md5(kmer || ':' || h), 1, 9) as bigint) % " + str(SIZING.bits)
_PLACES = f"select kmer, {_PLACE} as place from (select kmer, unnest(range(0, {SIZING.n_hashes})) as h from {{}})"
_WORDS = f"select place // 64 as word_idx, bit_or(case when place % 64 = 63 then cast(-9223372036854775808 as bigint) else cast(1 as bigint) << (place % 64) end) as word from ({_PLACES.format('ref')}) group by 1"
_EVENTS = "select user_id, min(ts) as b, max(ts) as e, count(*) as n, count(*) filter (where value > 50) as high from events group by user_id"
_CLEAN = "select doc_id, translate(text, '>@' || chr(13) || chr(10), '') as seq from documents"
_ROUND_TRIP = f"select doc_id, length(seq) as n, md5(seq) as digest from ({_CLEAN}) where seq <> ''"


def _case(pairs: list[tuple[str, object]], other: object) -> str:
    return "case " + " ".join(f"when {c} then {v}" for c, v in pairs) + f" else {other} end"


_K = _case([(f"n_bytes < {mib * params.MIB}", k) for mib, k in params.K_BY_MIB], params.K_LARGEST)
_T = _case([(f"k = {k}", f"cast({t} as double)") for k, t in params.THRESHOLD_BY_K.items()], f"cast({params.THRESHOLD_OTHER} as double)")
_HP = _case([(f"k <= {k}", f"cast({p} as double)") for k, p in params.HIT_PROBABILITY], f"cast({params.HIT_PROBABILITY_OTHER} as double)")
_SIZING_ROW = f"{K} as word_size, cast({SIZING.bits} as bigint) as bits, {SIZING.n_hashes} as n_hashes, cast({SIZING.capacity} as bigint) as capacity, '{SIZING.error_rate:e}' as error_rate"
_ITEM = f"""with ref as ({_ref("item_id,")}), tiles as ({_tiles()}), turned as (select * replace ({_RC.format("seq")} as seq) from tiles),
    {_strand("f0", "tiles", "item_id, doc_id, tile_no", extra=", ref.item_id")}, {_strand("r0", "turned", "item_id, doc_id, tile_no", extra=", ref.item_id")},
    hit as (select coalesce(f.item_id, r.item_id) as item_id, doc_id, tile_no, f.m as fm, f.runs as fr, f.anchor_hits as fa, r.m as rm, r.runs as rr, r.anchor_hits as ra
        from f0 f full join r0 r using (item_id, doc_id, tile_no)),
    hv as (select item_id, coalesce(fa > 0 and {_score("fm", "fr", "length(seq)")} >= cast({THRESHOLD} as float), false) as fp,
        coalesce(ra > 0 and {_score("rm", "rr", "length(seq)")} >= cast({THRESHOLD} as float), false) as rp, fa, fm, ra, rm from hit join tiles using (doc_id, tile_no)),
    agg as (select item_id, count(*) filter (where fp or rp) as c, sum((case when fa > 0 then fm else 0 end) + (case when fp then 0 when rp then 1 else coalesce(ra, 0) end) * coalesce(rm, 0)) as h from hv group by item_id),
    whole as (select count(*) as n, sum(length(seq)) as bases from tiles)
    {_rates("select item_id, n as total_read_count, coalesce(c, 0) as contaminated_reads, cast(coalesce(h, 0) as bigint) as total_hits, cast(bases as bigint) as all_k from (select distinct item_id from ref) left join agg using (item_id), whole", "item_id,")}"""
_MIXED = f"{_tiles()} union all select -conv_id * 1000 - turn - 1 as doc_id, tile_no, seq from ({_tiles('conversations', 'conv_id, turn')})"
_ASKED = f"select distinct substr(seq, p, {K}) as kmer from (select seq, unnest(range(1, length(seq) - {K} + 2)) as p from ({_tiles()}))"
_HALF = f"select doc_id, tile_no, case when tile_no % 2 = 1 then {_RC.format('seq')} else seq end as seq from ({_tiles()})"

ORACLE_SQL: dict[str, str] = {
    "contamination_report": _report(_tiles()),
    "kmer_spectrum": f"select substr(s, i, {K}) as kmer, count(*) as n from (select {_LOWER} as s, unnest(range(1, length(text) - {K} + 2)) as i from benchmark) group by 1",
    "anchor_kmers": f"select doc_id, tile_no, pos, kmer from ({_windows('(' + _tiles() + ')')}) where pos % {K} = 0 or pos = n - {K}",
    "revcomp_text": f"select doc_id, tile_no, {_RC.format('seq')} as rc from ({_tiles()})",
    "param_defaults": f"select doc_id, n_bytes, k, {_T} as threshold, {_HP} as hit_probability from (select *, {_K} as k from (select doc_id, n_chars * 100000 as n_bytes from documents))",
    "filter_info": f"select {_SIZING_ROW}, count(*) as inserts from ({_ref()})",
    "bloom_words": f"with ref as ({_ref()}) {_WORDS}",
    "bloom_membership": f"""with ref as ({_ref()}), words as ({_WORDS}), asked as ({_ASKED}),
        probe as (select kmer, bool_and(coalesce((word >> (place % 64)) & 1 = 1, false)) as in_filter from ({_PLACES.format("asked")}) p left join words on word_idx = place // 64 group by kmer)
        select in_filter, ref.kmer is not null as in_set, count(*) as n from probe left join ref using (kmer) group by 1, 2""",
    "screen_hits_semi": f"with ref as ({_ref()}) select distinct doc_id, tile_no from ({_windows('(' + _tiles() + ')')}) semi join ref using (kmer)",
    "screen_clean_anti": f"with ref as ({_ref()}), tiles as ({_tiles()}), hit as (select distinct doc_id, tile_no from ({_windows('tiles')}) semi join ref using (kmer)) select doc_id, tile_no from tiles anti join hit using (doc_id, tile_no)",
    "read_scores": f"""{_verdicts(_tiles())} select doc_id, tile_no, read_len, fwd_m as m, fwd_runs as runs, fwd_m + {K - 1} * fwd_runs as conse, fwd_m + {K - 2} * fwd_blocks as match_s,
        fwd_score as score, fwd_gate as gate, fwd_pass as contaminated from v""",
    "strand_verdicts": f"{_verdicts(_HALF)} select doc_id, tile_no, fwd_pass, rev_pass, contaminated, hits from v",
    "report_by_source_lang": f"{_verdicts(_tiles(cols='doc_id, source, lang'), 'source, lang,')} {_rates(f'select source, lang, {_TOTALS} from v group by rollup (source, lang)', 'source, lang,')}",
    "per_item_report": _ITEM,
    "remove_clean": f"{_verdicts(_tiles())} select doc_id, tile_no, seq from v where not contaminated",
    "remove_contam": f"{_verdicts(_tiles())} select doc_id, tile_no, seq from v where contaminated",
    "sampled_report": _report(f"select * from ({_tiles()}) where {_BUCKET} < 3"),
    "trim_reads": f"select * from ({_tiles()}) order by doc_id, tile_no limit 100",
    "every_other_read": f"select * from ({_tiles()}) where tile_no % 2 = 0",
    "mixed_reads": _report(_MIXED),
    "base_composition": "select lang, records, total, a, c, g, t, round(total / records, 6) as mean_length, round((c + g) / nullif(total, 0), 9) as gc from (select lang, count(*) as records, cast(sum(length(text)) as bigint) as total, "
    + ", ".join(f"cast(sum(length({_LOWER}) - length(replace({_LOWER}, '{x}', ''))) as bigint) as {x}" for x in "acgt")
    + " from documents group by lang)",
    "record_counts": f"""{_verdicts(_tiles(cols="doc_id, source, text"), "source, text,")},
        d as (select source, doc_id, bool_or(contaminated) as contaminated, any_value(text) as text from v group by source, doc_id)
        select source, records, contaminated, clean, case when clean = 0 then 100 else contaminated // clean end as rate from (select source, cast(sum(length(text) - length(replace(text, chr(10), '')) + 1) // 4 as bigint) as records,
        count(*) filter (where contaminated) as contaminated, count(*) filter (where not contaminated) as clean from d group by source)""",
    "roc_by_threshold": f"""{_verdicts(_tiles())}, d as (select doc_id, max(case when fwd_gate then fwd_score end) as score, sum(fwd_m) >= 50 as positive from v group by doc_id),
        g as (select threshold, coalesce(score >= cast(threshold as float), false) as called, positive from d, (select unnest([{", ".join(f"cast({t} as double)" for t in THRESHOLDS)}]) as threshold)),
        c as (select threshold, count(*) filter (where called) as called, count(*) filter (where called and positive) as tp, count(*) filter (where called and not positive) as fp,
            count(*) filter (where not called and positive) as fn, count(*) filter (where not called and not positive) as tn from g group by threshold)
        select *, round(tp / nullif(tp + fn, 0), 9) as tpr, round(fp / nullif(fp + tn, 0), 9) as fpr, round(fp / nullif(tp + fp, 0), 9) as q_f, round((tp + tn) / nullif(tp + fp + fn + tn, 0), 9) as accuracy from c""",
    "random_hit_rate": f"""{_verdicts(_tiles(cols="doc_id, lang"), "lang,")} select lang, hit, windows, round(hit / nullif(windows, 0), 9) as share, cast({params.default_hit_probability(K)} as double) as assumed
        from (select lang, cast(sum(fwd_m) as bigint) as hit, cast(sum(greatest(read_len - {K} + 1, 0)) as bigint) as windows from v group by lang)""",
    "tool_compare_join": f"""with e as ({_EVENTS}) select user_id || '.fastq' as sample, round(high / n, 9) as rate_a, round(high / n, 9) as rate_b,
        (epoch_us(e) - epoch_us(b)) / 1000000.0::double as seconds_a, (epoch_us(e) - epoch_us(b)) / 1000000.0::double as seconds_b from e where n >= 5""",
    "tool_compare_zip": f"with e as ({_EVENTS}) select user_id as ordinal, user_id || '.fastq' as sample, 'g' || (user_id % 5) as reference, round(high / n, 9) as rate_a, round(high / n, 9) as rate_b from e where n >= 5 and high > 0",
    "screen_tool_rates": """select user_id, round((a + b + c) / 100, 9) as rate from (select user_id, count(*) filter (where value > 20) % 30 as a, count(*) filter (where value > 50) % 30 as b,
        count(*) filter (where value > 80) % 30 as c from events group by user_id)""",
    "run_durations": "select user_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0::double as seconds from events group by user_id",
    "group_views": """select filter, sample, count(*) as n, cast(sum(size) as bigint) as total from (select regexp_extract(url, '^https?://([^/]*)', 1) as filter, regexp_replace(url, '^.*[\\\\/]', '') as sample, length(html) as size from pages)
        where filter <> '' and sample <> '' and size <> 0 group by 1, 2""",
    "sample_views": """select page_id, sample, regexp_replace(sample, '\\.[^.]*$', '') as stem from (select page_id, regexp_replace(url, '^.*[\\\\/]', '') as sample, regexp_extract(url, '^https?://([^/]*)', 1) as host from pages)
        where starts_with(host, 'th') and regexp_matches(sample, '^[0-9]+')""",
    "fasta_roundtrip": _ROUND_TRIP,
    "fasta_head_roundtrip": _ROUND_TRIP,
    "fastq_roundtrip": _ROUND_TRIP,
    "stream_report": _report(_tiles()),
}
