"""The queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_tokens import encoding_digests
from .common import table
from .conversation_repair import damaged, repair_report
from .decontamination import contaminated
from .line_dedup import remove_repeated_lines
from .lm_mixing import lm_scores, lm_token_counts
from .merkle import tampered_manifest
from .near_dedup import near_duplicate_groups
from .quality_classifier import quality_scores
from .sentence_pieces import encode_documents
from .substring_dedup import remove_repeated_spans, with_digest
from .token_counts import token_counts
from .toxicity import toxicity_scores
from .weak_rules import judged_documents


def piece_model() -> str:
    """The path of the SentencePiece model that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def word_bpe() -> str:
    """The path of the BPE tokenizer that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), piece_model())


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_digest(remove_repeated_spans(table(spark, sf_dir, "documents")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_documents(table(spark, sf_dir, "documents"))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(table(spark, sf_dir, "documents"), words=2, percent=80)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=1)
    return left.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(table(spark, sf_dir, "documents"), piece_model())
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


def op11_bpe_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(table(spark, sf_dir, "documents"), word_bpe())


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tampered_manifest(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(damaged(table(spark, sf_dir, "conversations")))


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op7, which SQL can express."""
    return judged_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def lm_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts that op2's scores rest on."""
    return lm_token_counts(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()} | {f.__name__: f for f in (quality_counts, lm_counts)}


_WORD = r"'[^\x20\x09-\x0D]+'"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _crc(text: str) -> str:
    """crc32 of an ASCII text, bit by bit."""
    return f"""xor(list_reduce(list_concat([4294967295::ubigint], list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i::int, 1))::ubigint)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], list_transform(range(8), lambda i: 0::ubigint)), lambda x, y: xor(x >> 1, case when x & 1 = 1 then 3988292384::ubigint else 0::ubigint end))), 4294967295::ubigint)"""


_CRC = _crc("doc_id::varchar")


def _merkle_sql(levels: int = 8) -> str:
    """16-ary levels, spelled out; a level above a tree's root leaves its only node as it is. 8 levels hold 4e9 leaves."""

    def tree(name: str, leaves: str) -> str:
        """Tables {name}0 .. {name}{levels} (tree, i, d), and in {name}k the children (c) of each node."""
        out = [f"{name}0 as ({leaves})"]
        for k in range(1, levels + 1):
            out.append(
                f"""{name}{k} as (select tree, i // 16 as i, case when any_value(n) = 1 then any_value(d) else sha256(string_agg(d, '' order by i)) end as d,
                case when any_value(n) = 1 then [] else list(d order by i) end as c from (select *, count(*) over (partition by tree) as n from {name}{k - 1}) group by tree, i // 16)"""
            )
        return ", ".join(out)

    def siblings(name: str, i: str) -> tuple[str, str]:
        """Joins to the parents of node i, and for each level the children without the node's own."""
        at = [f"({i} // {16**k})" for k in range(levels + 1)]
        joins = " ".join(f"join {name}{k} on {name}{k}.tree is not distinct from x.tree and {name}{k}.i = {at[k]}" for k in range(1, levels + 1))
        lists = ", ".join(f"{{'at': {at[k]} % 16 + 1, 'c': {name}{k + 1}.c}}" for k in range(levels))
        return joins, f"list_filter([{lists}], lambda s: len(s.c) > 0)"

    f = {c: f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')" for c in ("doc_id", "source", "lang", "n_chars", "text")}
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    shown = f"coalesce(strlen({low})::varchar || ':' || {low}, '-')"
    lower_joins, lower_list = siblings("l", "x.i")
    upper_joins, upper_list = siblings("u", "x.i")
    return f"""with h as (select doc_id, source, sha256({' || '.join(f.values())}) as leaf, case when doc_id is not null and {_CRC} % 5 = 0 then sha256({' || '.join([*f.values()][:4])} || {shown}) end as altered from documents),
        x as (select *, source as tree, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as i from h),
        {tree('l', 'select tree, i, leaf as d from x')}, roots as (select tree as source, d from l{levels}),
        {tree('u', "select 'all' as tree, row_number() over (order by source nulls first) - 1 as i, d from roots")},
        su as (select 'all' as tree, source, d as subroot, row_number() over (order by source nulls first) - 1 as i from roots),
        up as (select source, subroot, {upper_list} as steps from su x {upper_joins}),
        lo as (select x.doc_id, x.source, leaf, altered, {lower_list} as steps from x {lower_joins}),
        p as (select lo.doc_id, leaf, coalesce(altered, leaf) as start, subroot, list_concat(lo.steps, up.steps) as steps, (select d from u{levels}) as root from lo join up on up.source is not distinct from lo.source),
        q as (select *, list_transform(steps, lambda s: {{'b': array_to_string(s.c[:s.at - 1], ''), 'a': array_to_string(s.c[s.at + 1:], '')}}) as sides from p),
        r as (select *, list_reduce(list_concat([start], list_transform(sides, lambda s: s.b || '|' || s.a)), lambda d, s: sha256(split_part(s, '|', 1) || d || split_part(s, '|', 2))) as folded_root from q)
        select doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(sides, lambda s: s.b || s.a), '')) as proof_sha256, folded_root, folded_root = root as verified from r"""


def _repair_sql() -> str:
    """Forward over the rows: the least (cost, audit) of each state, with up to two insertions behind each row."""
    blank = r"[^\x20\x09-\x0D]"
    new = "case state when 'u' then 'a' else 'u' end"
    insert = """select conv_id, k, state, cost, audit, script from s union all select conv_id, k, {new}, cost + 5, audit || 'I', list_append(script, case state when 'u' then 'assistant:' else 'user:' end) from s
        union all select conv_id, k, case when state = 'u' then 'u' else 'a' end, cost + 10, audit || 'II', list_concat(script, case when state = 'u' then ['assistant:', 'user:'] else ['user:', 'assistant:'] end) from s""".format(new=new)
    return f"""with recursive c as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
        f as (select *, {_crc('key')} % 20 as fate from c),
        d as (select conv_id, turn, case when fate = 4 then 'user' else role end as role, case fate when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
            unnest(range(case fate when 0 then 0 when 3 then 2 else 1 end)) as copy from f),
        o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text), copy) as k from d),
        t as (select *, case when not regexp_matches(text, '{blank}') then 'blank' when row_number() over (partition by conv_id, role, text order by k) > 1 then 'duplicate'
            when not regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') then 'truncated' else '' end as fault, substr(role, 1, 1) as x, lag(substr(role, 1, 1)) over (partition by conv_id order by k) as w from o),
        best(conv_id, k, state, cost, audit, script) as (
            with s as (select distinct conv_id, cast(0 as bigint) as k, '' as state, cast(0 as bigint) as cost, '' as audit, cast([] as varchar[]) as script from c)
            {insert}
            union all
            (with step as (select b.*, r.role, r.text, r.x, r.fault, case when r.fault = 'truncated' then 5 else 0 end as more from best b join t r on r.conv_id is not distinct from b.conv_id and r.k = b.k + 1),
            s as (select conv_id, k + 1 as k, state, cost + 2 as cost, audit || 'D' as audit, script from step
                union all select conv_id, k + 1, x, cost + more, audit || 'K', list_append(script, role || ':' || text) from step
                    where fault not in ('blank', 'duplicate') and ((x = 's' and state = '') or (x = 'u' and state <> 'u') or (x = 'a' and state = 'u'))
                union all select conv_id, k + 1, {new}, cost + 1 + more, audit || 'R', list_append(script, case state when 'u' then 'assistant:' else 'user:' end || text) from step where fault not in ('blank', 'duplicate')),
            i as ({insert})
            select conv_id, k, state, cost, audit, script from i qualify row_number() over (partition by conv_id, state order by cost, audit) = 1)),
        n as (select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
            count(*) filter (fault = 'truncated') as truncated, count(*) filter (w is not null and w || x not in ('su', 'ua', 'au')) as illegal from t group by 1),
        ids as (select distinct conv_id from c)
        select ids.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, cost, audit, sha256(array_to_string(script, chr(10))) as repaired_sha256
        from ids left join n on n.conv_id is not distinct from ids.conv_id join best on best.conv_id is not distinct from ids.conv_id and best.k = coalesce(n.n, 0) and best.state in ('', 'a')
        qualify row_number() over (partition by ids.conv_id order by cost, audit) = 1"""


def oracle_sql() -> dict[str, str]:
    return {
        "op13_conversation_repair": _repair_sql(),
        "op12_merkle_manifest": _merkle_sql(),
        "op5_substring_dedup": f"""with d as (select doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) as w from documents),
            win as (select doc_id, i, array_to_string(w[i:i + 19], ' ') as t from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from d)),
            late as (select doc_id, i from (select doc_id, i, row_number() over (partition by t order by doc_id, i) as r from win) where r > 1),
            gone as (select distinct doc_id, unnest(range(i, i + 20)) as j from late),
            kept as (select x.doc_id, string_agg(x.t, ' ' order by x.j) as k, count(*) as n from (select doc_id, unnest(w) as t, unnest(range(1, len(w) + 1)) as j from d) x
                left join gone g on g.doc_id = x.doc_id and g.j = x.j where g.j is null group by 1)
            select d.doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(k, '')) as kept_sha256 from d left join kept using (doc_id)""",
        "op8_minhash_dedup": f"""with recursive d as (select doc_id, regexp_extract_all({_LOWER}, {_WORD}) as w from documents),
            s as (select doc_id, case when len(w) < 2 then w else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end as s from d),
            e as (select doc_id, len(s) as n, unnest(s) as g from s),
            links as (select a.doc_id as x, b.doc_id as y from e a join e b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2 having 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
            walk(doc_id, node) as (select doc_id, doc_id from s union select walk.doc_id, y from walk join links on node = x),
            c as (select doc_id, min(node) as component_id from walk group by 1)
            select doc_id, cast(len(s) as bigint) as n_shingles, component_id, doc_id = component_id as kept from s join c using (doc_id)""",
        "quality_counts": f"""with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), {_WORD}) as w from documents),
            win as (select doc_id, i, count(*) over (partition by doc_id, t) as n from (select doc_id, i, array_to_string(w[i:i + 4], ' ') as t from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from d))),
            rep as (select doc_id, count(distinct j) as r from (select doc_id, unnest(range(i, i + 5)) as j from win where n > 1) group by 1),
            l as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {_WORD})) as l from d)
            select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars,
                cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines,
                cast(coalesce(r, 0) as bigint) as n_repeat_words, len(w) < 10 or 100 * coalesce(r, 0) > 20 * len(w) as base_failed from d join l using (doc_id) left join rep using (doc_id)""",
        "lm_counts": f"""with d as (select doc_id, list_concat(regexp_extract_all({_LOWER}, {_WORD}), [chr(10)]) as w, {_CRC} % 5 = 1 as held_out from documents),
            t as (select doc_id, held_out, unnest(w) as t from d), c as (select t, count(*) as c from t where not held_out group by 1)
            select doc_id, held_out, count(*) as n_tokens, count(c) as n_known, cast((select sum(c) from c) as bigint) as train_tokens from t left join c using (t) group by 1, 2""",
    }
