"""DuckDB SQL for the registered queries of the corpus operators: the same results, said another way."""

from __future__ import annotations

#: RE2 has no lookaround and knows ASCII white space alone, so classes are spelled out.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
DARK = SPACE.replace("[", "[^", 1)
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
ALNUM = "A-Za-z0-9ĄąĆćĘęŁłŃńÓóŚśŹźŻż"

SPLIT = "case when doc_id % 10 = 0 then 'validation' when doc_id % 10 = 1 then 'test' else 'train' end"
RAW = f"""raw as (
    select {SPLIT} as split, doc_id as row_index,
        case when strpos(text, chr(10)) > 0 then substr(text, 1, strpos(text, chr(10)) - 1) else text end as pl,
        case when strpos(text, chr(10)) > 0 then substr(text, strpos(text, chr(10)) + 1) end as en
    from documents
)"""
NONE = f"{RAW}, pairs as (select split, row_index, coalesce(pl, 'None') as pl, coalesce(en, 'None') as en from raw)"
LABELS = f"labels_ as (select {SPLIT} as split, doc_id as row_index, case when toxic = 1 then 0 when quality = 1 then 2 else 1 end as label from labels)"


def norm(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, '{CONTROL}', '', 'g'), '{SPACE}+', ' ', 'g'))"


def n_words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{DARK}+'))"


def sanitise(x: str) -> str:
    x = f"translate({x}, '–—−', '---')"
    x = f"regexp_replace({x}, '(^|[^{ALNUM}])(?:\\.{{3}})+', '\\1 ', 'g')"
    x = f"regexp_replace({x}, '(^|[^.])((?:\\.{{3}})*)\\.{{3}}({SPACE}*)$', '\\1\\2§\\3')"
    x = f"replace(regexp_replace({x}, '\\.{{3}}', ' ', 'g'), '§', '...')"
    x = f"regexp_replace({x}, '[^ {ALNUM}?.,:;''!\"\\-]', ' ', 'g')"
    x = f"regexp_replace({x}, '^ *-+ *', '')"
    return x


def blanked(x: str) -> str:
    head = f"regexp_extract({x}, '^[^{ALNUM}]*')"
    return f"trim(regexp_replace(translate({head}, '-', ' ') || substr({x}, length({head}) + 1), '{SPACE}+', ' ', 'g'))"


def _rules(min_words: int, identical: bool = True, max_words: int = 200, ratio: float = 4.0) -> list[tuple[str, str]]:
    found = [("identical_source_target", "pl = en")] if identical else []
    return [*found, ("min_words", f"least(a, b) < {min_words}"), ("max_words", f"greatest(a, b) > {max_words}"), ("length_ratio", f"greatest(a, b) / greatest(1, least(a, b))::double > {ratio}")]


def classified(scope: str = "global", heldout_first: bool = True, leaks: bool = True, min_words: int = 1, source: str = "raw") -> str:
    """CTEs up to ``classified`` (split, row_index, pl, en, reasons) by running windows over the rows in order."""
    order = ("validation", "test", "train") if heldout_first else ("train", "validation", "test")
    rank = "case split " + " ".join(f"when '{s}' then {i}" for i, s in enumerate(order)) + " end"
    rules = _rules(min_words)
    ok = " and ".join(f"not ({p})" for _, p in rules)
    leak = "split = 'train' and held" if leaks else "false"
    by = "pl, en" + (", split" if scope == "split" else "")
    listed = ", ".join(f"case when {p} then '{n}' end" for n, p in rules)
    return f"""norm as (
        select split, row_index, {rank} as rank, pl is null or en is null as missing,
            case when pl is null or en is null then '' else {norm("pl")} end as pl, case when pl is null or en is null then '' else {norm("en")} end as en
        from {source}
    ), sized as (select *, not missing and (pl = '' or en = '') as empty, {n_words("pl")} as a, {n_words("en")} as b from norm),
    held as (select *, bool_or(split <> 'train') over (partition by pl, en) as held from sized where not missing and not empty),
    ruled as (select *, {leak} as leak, {ok} as ok from held),
    counted as (select *, coalesce(sum(case when ok and not leak then 1 else 0 end) over (partition by {by} order by rank, row_index rows between unbounded preceding and 1 preceding), 0) as before from ruled),
    classified as (
        select split, row_index, pl, en, array_to_string(list_filter([{listed}, case when leak then 'train_pair_present_in_validation_or_test' end, case when before > 0 then 'duplicate' end], lambda x: x is not null), '|') as reasons from counted
        union all select split, row_index, pl, en, case when missing then 'null_pair' else 'empty_pair' end from sized where missing or empty
    )"""


def shown(ctes: str) -> str:
    return f"with {RAW}, {ctes} select split, row_index, pl, en, reasons as all_reasons, split_part(reasons, '|', 1) as reason from classified"


def preaudited(max_words: int = 200, ratio: float = 4.0) -> str:
    rules = _rules(1, True, max_words, ratio)
    cases = " ".join(f"when {p} then '{n}'" for n, p in rules)
    bracket = lambda c: f"regexp_replace(coalesce({c}, 'None'), '\\[[^\\]]*\\]', ' ', 'g')"
    return f"""rough as (select split, row_index, {sanitise(bracket("pl"))} as pl, {sanitise(bracket("en"))} as en from raw),
    clean as (select split, row_index, {blanked("pl")} as pl, {blanked("en")} as en from rough),
    csized as (select *, {n_words("pl")} as a, {n_words("en")} as b from clean),
    cruled as (select *, case when pl = '' or en = '' then 'empty_pair' {cases} end as rule from csized),
    preaudited as (
        select split, row_index, pl, en, case when rule is not null then rule when row_number() over (partition by split, pl, en, rule is null order by row_index) > 1 then 'duplicate_pair' else '' end as reason from cruled
    )"""


def labelled(accepted: str) -> str:
    return f"""with {RAW}, {LABELS}, {preaudited()},
    joined as (select p.*, l.label from preaudited p left join labels_ l using (split, row_index)),
    stopped as (
        select *, case when reason <> '' then 'preaudit_' || reason when label is null then 'missing_llm_label' when label not in ({accepted}) then 'llm_label_not_kept' end as stop from joined
    ), passed as (select split, row_index, pl, en from stopped where stop is null),
    {classified(source="passed")}
    select split, row_index, pl, en, reasons as all_reasons, split_part(reasons, '|', 1) as reason from classified
    union all select split, row_index, pl, en, stop, stop from stopped where stop is not null"""


LINES = f"""{LABELS}, lines as (
    select row_index * 2 as line_no, case when row_index % 50 = 7 then 'other' else split end as split, row_index, label from labels_
    union all select row_index * 2 + 1, split, row_index, 2 - label from labels_ where row_index % 7 = 0
)"""
# In the long form the names bad, uncertain, good stand at places 3, 2, 1 from the label, so it reads as 2 minus the label.

BATCHES = f"""{RAW}, {preaudited(10**6, 1e6)}, kept as (
    select split, row_index, pl, en, length('id:' || row_index || ' pl:' || pl || ' en:' || en) as n, row_number() over (partition by split order by row_index) as k from preaudited where reason = ''
), walk as (
    select split, k, n as chars, 1 as rows, 0 as batch_index, 0 as local_id from kept where k = 1
    union all
    select w.split, q.k, case when w.rows >= 7 or w.chars + q.n > 4000 then q.n else w.chars + q.n end, case when w.rows >= 7 or w.chars + q.n > 4000 then 1 else w.rows + 1 end,
        case when w.rows >= 7 or w.chars + q.n > 4000 then w.batch_index + 1 else w.batch_index end, case when w.rows >= 7 or w.chars + q.n > 4000 then 0 else w.rows end
    from walk w join kept q on q.split = w.split and q.k = w.k + 1
), batched as (select q.split, q.row_index, q.pl, q.en, w.batch_index, w.local_id from walk w join kept q on q.split = w.split and q.k = w.k)"""

#: What each of the seven answers comes to: error, good, bad, uncertain.
ANSWERS = """answers as (
    select doc_id, case doc_id % 7 when 2 then 'id in two lists' when 3 then 'foreign id' when 4 then 'missing list' when 5 then 'missing list' else '' end as error,
        case doc_id % 7 when 0 then '0,1' when 1 then '0,2' when 6 then '' else '-' end as good, case doc_id % 7 when 0 then '2' when 1 then '' when 6 then '' else '-' end as bad,
        case doc_id % 7 when 0 then '' when 1 then '1' when 6 then '0,1,2' else '-' end as uncertain, case doc_id % 7 when 0 then 0 when 1 then 1 when 6 then 3 end as u
    from documents
)"""
SETTLED = f"""{ANSWERS}, tries as (select *, cast(floor(doc_id / 3) as bigint) as batch_index, doc_id % 3 + 1 as attempt, error = '' and u / 3.0 <= 0.4 as enough from answers),
made as (select *, coalesce(bool_or(enough) over (partition by batch_index order by attempt rows between unbounded preceding and 1 preceding), false) as stopped from tries),
settled as (
    select batch_index, count(*) as attempts, coalesce(max_by(good, attempt) filter (where error = ''), '') as good, coalesce(max_by(bad, attempt) filter (where error = ''), '') as bad,
        coalesce(max_by(uncertain, attempt) filter (where error = ''), '0,1,2') as uncertain
    from made where not stopped group by batch_index
)"""

FREQ = f"""{NONE}, train as (select * from pairs where split = 'train'),
tokens as (
    select row_index, side, unnest(w) as raw_word, unnest(range(len(w))) as place from (
        select row_index, 0 as side, regexp_extract_all(pl, '[\\p{{L}}\\p{{N}}_]+') as w from train union all select row_index, 1, regexp_extract_all(en, '[\\p{{L}}\\p{{N}}_]+') from train)
), freq as (
    select word, count(*) as cnt, min({{'r': row_index, 's': side, 'p': place}}) as f from (select *, lower(raw_word) as word from tokens) group by word
)"""


def encode(c: str, unknown: str | None = "the") -> str:
    one = f"case when w = '{unknown}' then 1 else 4 + length(w) % 20 end" if unknown else "4 + length(w) % 20"
    return f"list_transform(regexp_extract_all({c}, '[^\\t\\n\\x0B\\f\\r ]+'), lambda w: {one})"


def p95(values: str) -> str:
    return f"list_sort(list({values}))[least(count(*), cast(floor(count(*) * 0.95::double) as bigint) + 1)]"


def examples(unknown: str | None = None) -> str:
    return f"""{NONE}, enc as (select row_index, {encode("pl", unknown)} as s, {encode("en", unknown)} as t from pairs where split = 'train'),
    ids as (select row_index, list_append(s, 3) as src_ids, list_prepend(2, t) as tgt_in_ids, list_append(t, 3) as tgt_out_ids from enc),
    marked as (select *, greatest(len(src_ids), len(tgt_in_ids), len(tgt_out_ids)) > 128 as overlength from ids)"""


PADDED = f"""{examples()}, batches as (select *, cast(floor((row_number() over (order by row_index) - 1) / 48) as bigint) as batch_id from marked where not overlength),
widths as (select batch_id, ceil(max(len(src_ids)) / 8.0)::bigint * 8 as s, ceil(max(len(tgt_in_ids)) / 8.0)::bigint * 8 as i, ceil(max(len(tgt_out_ids)) / 8.0)::bigint * 8 as o, max(len(src_ids)) as plain, count(*) as n from batches group by batch_id),
padded as (
    select row_index, batch_id, n, s, i, plain, list_concat(src_ids, list_transform(range(s - len(src_ids)), lambda x: 0)) as src_ids,
        list_concat(tgt_in_ids, list_transform(range(i - len(tgt_in_ids)), lambda x: 0)) as tgt_in_ids, list_concat(tgt_out_ids, list_transform(range(o - len(tgt_out_ids)), lambda x: 0)) as tgt_out_ids
    from batches join widths using (batch_id)
)"""

PAIRS_OF_LINES = "lines as (select doc_id as index, coalesce(string_split(text, chr(10))[1], '') as hypothesis, coalesce(string_split(text, chr(10))[2], '') as reference from documents)"


def tokens_13a(c: str) -> str:
    for a, b in (("'<skipped>'", "''"), ("'-' || chr(10)", "''"), ("chr(10)", "' '"), ("'&quot;'", "'\"'"), ("'&amp;'", "'&'"), ("'&lt;'", "'<'"), ("'&gt;'", "'>'")):
        c = f"replace({c}, {a}, {b})"
    c = f"' ' || {c} || ' '"
    for pattern, to in ((r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "), (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")):
        c = f"regexp_replace({c}, '{pattern}', '{to}', 'g')"
    return f"regexp_extract_all({c}, '{DARK}+')"


def ngrams(split, order: int) -> str:
    return f"""{PAIRS_OF_LINES}, items as (select index, 1 as h, 0 as r, {split("hypothesis")} as w from lines union all select index, 0, 1, {split("reference")} from lines),
    sizes as (select unnest(range(1, {order + 1})) as n),
    grams as (select index, n, h, r, array_to_string(w[s : s + n - 1], ' ') as gram from (select index, n, h, r, w, unnest(range(1, len(w) - n + 2)) as s from items, sizes where len(w) >= n)),
    per as (select index, n, gram, sum(h) as h, sum(r) as r from grams group by all),
    stats as (select n, sum(least(h, r))::bigint as match, sum(h)::bigint as hyp, sum(r)::bigint as ref from per group by n)"""


#: Character n-grams, up to order 6, of texts without white space.
CHAR_NGRAMS = f"""{PAIRS_OF_LINES}, items as (
        select index, 1 as h, 0 as r, regexp_replace(hypothesis, '{SPACE}+', '', 'g') as t from lines union all select index, 0, 1, regexp_replace(reference, '{SPACE}+', '', 'g') from lines
    ), sizes as (select unnest(range(1, 7)) as n),
    grams as (select index, n, h, r, substr(t, s, n) as gram from (select index, n, h, r, t, unnest(range(1, length(t) - n + 2)) as s from items, sizes where length(t) >= n)),
    per as (select index, n, gram, sum(h) as h, sum(r) as r from grams group by all),
    stats as (select n, sum(least(h, r))::bigint as match, sum(h)::bigint as hyp, sum(r)::bigint as ref from per group by n)"""

LOGITS = """logits as (
    select vec_id, vec_id % 10 as target, vec_id % 4 as batch, list_transform(embedding[1:10], lambda x: x::double * 8) as l from embeddings where embedding is not null
), losses as (
    select batch, 0.9 * -(l[target + 1] - m - z) + 0.1 * -(list_sum(list_transform(l, lambda x: x - m - z)) / 10) as loss
    from (select *, ln(list_sum(list_transform(l, lambda x: exp(x - m)))) as z from (select *, list_max(l) as m from logits)) where target <> 0
)"""

CLEAN = f"with {RAW}, {classified()}"
FIRST = "split_part(reasons, '|', 1)"

SQL: dict[str, str] = {
    "scan_pairs": f"with {NONE} select split, row_index, pl, en from pairs",
    "limited_scan": f"with {NONE} select split, row_index from pairs where row_index < 100",
    "row_counts": f"with {RAW} select split, count(*) as n, 2 * count(*) as lines from raw group by split",
    "normalize_text": f"with {RAW} select row_index, pl is null or en is null as missing, case when pl is null or en is null then '' else {norm('pl')} end as pl, case when pl is null or en is null then '' else {norm('en')} end as en from raw",
    "word_counts": f"select doc_id, {n_words('text')} as n_words, {n_words('text')} as n_normalised from documents",
    "sanitize_text": f"with rough as (select doc_id, {sanitise(chr(39) + '— ' + chr(39) + ' || ' + chr(39) + '  ' + chr(39) + ' || replace(substr(text, 1, 400), ' + chr(39) + ', ' + chr(39) + ', ' + chr(39) + '... ' + chr(39) + ') || ' + chr(39) + ' 你好 x...' + chr(39))} as x from documents) select doc_id, {blanked('x')} as clean from rough",
    "clean_reason_counts": f"{CLEAN} select coalesce(split, 'all') as split, {FIRST} as reason, count(*) as n from classified where reasons <> '' group by grouping sets ((split, {FIRST}), ({FIRST}))",
    "clean_global": shown(classified()),
    "clean_split_scope": shown(classified("split")),
    "clean_train_first": shown(classified(heldout_first=False)),
    "clean_keep_leaks": shown(classified(leaks=False, min_words=5)),
    "clean_rollup": f"{CLEAN}, t as (select split, count(*) as rows_in, count(*) filter (where reasons = '') as rows_out from classified group by rollup (split)) select coalesce(split, 'all') as split, rows_in, rows_out, rows_in - rows_out as removed_total, round(rows_out / greatest(1, rows_in)::double, 6) as retention_ratio from t",
    "clean_reason_maps": f"{CLEAN}, c as (select split, {FIRST} as reason, count(*) as n from classified where reasons <> '' group by all) select split, string_agg(reason || '=' || n, ',' order by reason) as reasons from c group by split",
    "preaudit_rows": f"with {RAW}, {preaudited()} select split, row_index, pl, en, reason from preaudited",
    "preaudit_dropped": f"with {RAW}, {preaudited()} select coalesce(split, 'all') as split, reason, count(*) as n from preaudited where reason <> '' group by grouping sets ((split, reason), (reason))",
    "label_filter_good": labelled("2"),
    "label_filter_keep_uncertain": labelled("2, 1"),
    "label_stats": f"with {LABELS} select coalesce(split, 'all') as split, count(*) filter (where label = 2) as good, count(*) filter (where label = 0) as bad, count(*) filter (where label = 1) as uncertain from labels_ group by rollup (split)",
    "label_last_wins": f"with {LINES} select split, row_index, cast(max_by(label, line_no) as bigint) as label from lines where split <> 'other' group by split, row_index",
    "label_load_stats": f"with {LINES}, k as (select split, split <> 'other' as known, row_number() over (partition by split, row_index order by line_no) > 1 as again from lines), s as (select split, count(*) as loaded, count(*) filter (where again) as duplicates, 0::bigint as unknown_split from k where known group by split union all select 'all', count(*) filter (where known), count(*) filter (where known and again), count(*) filter (where not known) from k) select * from s",
    "label_replay": f"with {LINES} select split, row_index, cast(min_by(label, line_no) as bigint) as label from lines where split <> 'other' group by split, row_index",
    "leak_anti_join": f"with {RAW} select row_index from raw t where split = 'train' and en is not null and not exists (select 1 from raw h where h.split <> 'train' and h.pl = t.pl and h.en = t.en)",
    "heldout_union": f"with {RAW} select distinct md5(pl || chr(31) || en) as key from raw where split <> 'train' and en is not null",
    "audit_batches": f"with recursive {BATCHES} select split, row_index, batch_index::bigint as batch_index, local_id::bigint as local_id from batched",
    "audit_prompts": f"with recursive {BATCHES} select split, batch_index::bigint as batch_index, count(*) as size, string_agg(row_index, ',' order by local_id) as row_ids, md5(string_agg('id:' || local_id || ' pl:' || pl || ' en:' || en, chr(10) order by local_id)) as lines_md5 from batched group by split, batch_index",
    "audit_validate": f"with {ANSWERS} select doc_id, error, good, bad, uncertain from answers",
    "audit_settle": f"with {SETTLED} select 'train' as split, batch_index, attempts, good, bad, uncertain from settled",
    "audit_labels": f"with {SETTLED}, i as (select *, unnest([0, 1, 2]) as i from settled) select 'train' as split, batch_index * 3 + i as row_index, case when list_contains(string_split(good, ','), i::varchar) then 2 when list_contains(string_split(bad, ','), i::varchar) then 0 else 1 end::bigint as label from i",
    "audit_running_totals": f"with {LABELS}, b as (select split, cast(floor(row_index / 25) as bigint) as batch_index, count(*) filter (where label = 2) as good, count(*) filter (where label = 0) as bad, count(*) filter (where label = 1) as uncertain from labels_ group by all) select split, batch_index, cast(sum(good) over w as bigint) as good, cast(sum(bad) over w as bigint) as bad, cast(sum(uncertain) over w as bigint) as uncertain from b window w as (partition by split order by batch_index)",
    "audit_rewind": f"with {LABELS}, log as (select row_index + 1 as line_no, split from labels_ where row_index % 5 = 0) select split, row_index from (select *, row_number() over (partition by split order by row_index desc) as back from labels_) where split <> 'train' or back > 4 or not exists (select 1 from log where split = 'train') union all select 'log-' || split, line_no from log where not (split = 'train' and line_no = (select max(line_no) from log where split = 'train'))",
    "audit_resume": f"with recursive {BATCHES} select distinct split, batch_index::bigint as batch_index from batched where split = 'train' or split = 'test' and batch_index >= 2",
    "audit_rerun": "select doc_id, case when doc_id % 11 <= 0 then true else (doc_id % 9) / (doc_id % 11)::double > 0.4 end as rerun, round((doc_id % 9) / greatest(1, doc_id % 11)::double, 4) as ratio from labels",
    "audit_bad_sentences": f"with {RAW}, {LABELS} select split, count(*) as count, count(*) as records, min(row_index) as first_row from raw join labels_ using (split, row_index) where label = 0 group by split",
    "word_freq": f"with {FREQ} select word, cnt, f.r as first_row, f.s::bigint as first_side, f.p as first_place from freq",
    "split_token_stats": f"with {NONE}, s as (select split, unnest([pl, en]) as x from pairs), e as (select split, {n_words('x')} as w, {encode('x')} as ids from s), q as (select split, w, len(ids) as n, len(list_filter(ids, lambda i: i = 1)) as u from e) select split, count(*) // 2 as rows, sum(w)::bigint as words, sum(n)::bigint as pieces, sum(u)::bigint as unk, round(avg(n), 6) as mean_pieces, {p95('n')} as p95_pieces, round(case when sum(w) = 0 then 0 else sum(n) / sum(w)::double end, 6) as pieces_per_word, round(case when sum(n) = 0 then 0 else sum(u) / sum(n)::double end, 6) as unk_rate from q group by split",
    "long_word_buckets": f"with {FREQ}, b as (select case when cnt <= 1 then 'freq_1' when cnt <= 5 then 'freq_2_5' when cnt <= 50 then 'freq_6_50' else 'freq_gt_50' end as bucket, (length(word) - 1) // 3 + 1 as n from freq where length(word) >= 12), s as (select bucket, count(*) as types, avg(n) as mean, {p95('n')} as p95 from b group by bucket) select v.bucket, coalesce(types, 0) as types, round(coalesce(mean, 0), 6) as mean_pieces, coalesce(p95, 0)::bigint as p95_pieces from (values ('freq_1'), ('freq_2_5'), ('freq_6_50'), ('freq_gt_50')) v(bucket) left join s using (bucket)",
    "top_long_words": f"with {FREQ} select row_number() over (order by cnt desc, f) as rank, word, cnt, (length(word) - 1) // 3 + 1 as pieces from freq where length(word) >= 12 order by cnt desc, f limit 30",
    "bpe_pairs": f"with {FREQ}, c as (select cnt, list_transform(regexp_extract_all(word, '(?s).'), lambda x, i: case when i = 1 then '▁' || x else x end) as s from freq), p as (select cnt, s[i] as l, s[i + 1] as r from (select cnt, s, unnest(range(1, len(s))) as i from c)) select l as left, r as right, sum(cnt)::bigint as n from p group by all order by n desc, l, r limit 25".replace("as left, r as right", 'as "left", r as "right"'),
    "corpus_lines": f"with {NONE} select row_index, 0::bigint as side, replace(pl, chr(10), ' ') as line from pairs where split = 'train' union all select row_index, 1, replace(en, chr(10), ' ') from pairs where split = 'train'",
    "encode_examples": f"with {examples('the')} select row_index, array_to_string(src_ids, ',') as src_ids, array_to_string(tgt_in_ids, ',') as tgt_in_ids, array_to_string(tgt_out_ids, ',') as tgt_out_ids from marked where not overlength",
    "overlength_stats": f"with {examples()} select count(*) as rows_in, count(*) filter (where overlength) as overlength, count(*) filter (where not overlength) as examples from marked",
    "collate_padded": f"with {PADDED} select row_index, batch_id, array_to_string(src_ids, ',') as src_ids, array_to_string(tgt_in_ids, ',') as tgt_in_ids, array_to_string(tgt_out_ids, ',') as tgt_out_ids from padded",
    "collate_batches": f"with {PADDED} select distinct batch_id, n, s as src_width, i as tgt_width, i as causal from padded",
    "source_padding": f"with {PADDED} select row_index, array_to_string(src_ids[1:plain], ',') as src_ids from padded",
    "pad_masks": f"with {PADDED} select row_index, array_to_string(list_transform(src_ids, lambda x: (x = 0)::int), '') as src_pad, array_to_string(list_transform(tgt_in_ids, lambda x: (x = 0)::int), '') as tgt_pad from padded",
    "causal_mask": "select n as size, array_to_string(list_transform(range(n), lambda i: repeat('0', i::int + 1) || repeat('1', (n - i)::int - 1)), '|') as mask from range(1, 13) t(n)",
    "attention_masks": "select id, repeat('1', id::int) || repeat('0', 6 - id::int) as src, array_to_string(list_transform(range(6), lambda i: repeat('1', least(id, i + 1)::int) || repeat('0', 6 - least(id, i + 1)::int)), '|') as tgt from range(1, 7) t(id)",
    "bleu_stats": f"with {ngrams(tokens_13a, 4)} select n, match, hyp, ref from stats",
    "chrf_stats": f"with {CHAR_NGRAMS} select n, match, hyp, ref from stats",
    "bleu_score": f"""with recursive {ngrams(tokens_13a, 4)}, filled as (select s.n, coalesce(match, 0) as match, coalesce(hyp, 0) as hyp, coalesce(ref, 0) as ref from sizes s left join stats using (n)),
        scan as (
            select 1 as n, case when match = 0 then 1 else 0 end as k, case when hyp = 0 then 0.0 when match = 0 then ln(100.0 / (2.0 * hyp)) else ln(100.0 * match / hyp) end as l, hyp = 0 as stopped from filled where n = 1
            union all select f.n, k + case when match = 0 then 1 else 0 end, l + case when stopped or hyp = 0 then 0.0 when match = 0 then ln(100.0 / (power(2.0, k + 1) * hyp)) else ln(100.0 * match / hyp) end, stopped or hyp = 0 from scan join filled f on f.n = scan.n + 1
        ), one as (select * from filled where n = 1)
        select round(case when (select sum(match) from filled) = 0 or (select min(hyp) from filled) = 0 then 0.0 else case when hyp >= ref then 1.0 when hyp = 0 then 0.0 else exp(1 - ref / hyp::double) end * exp((select l from scan where n = 4) / 4) end, 6) as bleu from one""",
    "chrf_score": f"with {CHAR_NGRAMS}, m as (select avg(match / hyp::double) as p, avg(match / ref::double) as r from stats where hyp > 0 and ref > 0) select round(case when p + r = 0 then 0 else 100 * 5 * p * r / (4 * p + r) end, 6) as chrf from m",
    "lr_schedule": "select s as step, round(least(power(greatest(1, s), -0.5), greatest(1, s) * power(4000.0::double, -1.5)) * sqrt(4000.0::double), 9) as multiplier from range(0, 20001, 250) t(s)",
    "length_penalty": "select event_id, round(value / power(greatest(1, event_id % 40), 0.7), 6) as score from events",
    "sequence_lengths": "with i as (select doc_id, list_transform(range(1, 9), lambda i: (doc_id * i + i) % 9) as ids from documents) select doc_id, coalesce(list_position(ids, 3), 8)::bigint as length from i",
    "positional_encoding": "select p as position, i as place, round(case when i % 2 = 0 then sin(p * exp((i - i % 2) * (-ln(10000.0) / 8))) else cos(p * exp((i - i % 2) * (-ln(10000.0) / 8))) end, 6) as value from range(16) a(p), range(8) b(i)",
    "label_smoothed_ce": f"with {LOGITS} select batch, round(avg(loss), 6) as loss from losses group by batch",
    "validation_loss": f"with {LOGITS}, b as (select avg(loss) as loss from losses group by batch) select round(coalesce(avg(loss), 'inf'::double), 6) as loss from b",
    "greedy_argmax": f"with {LOGITS} select vec_id, (list_position(l, list_max(l)) - 1)::bigint as best from logits",
    "early_stopping": "with m as (select user_id, event_id as step, coalesce(value < min(value) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), true) as improved from events), i as (select *, sum(improved::int) over (partition by user_id order by step) as island from m), w as (select *, row_number() over (partition by user_id, island order by step) - 1 as waited from i) select user_id, step, improved, waited, waited >= 3 as stop from w",
    "best_hypothesis": "select event_id // 5 as index, arg_max(event_id % 5, {'p': -abs(value) / greatest(1, event_id % 6 + 1), 'b': -(event_id % 5)}) as beam from events group by event_id // 5",
}
