"""One query for each operator over its whole table, and the SQL that says the same where SQL can."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmine.llm import chat_tree, decontaminate, hard_negatives, jaccard_join, language, line_dedup, merkle, mixing, quality, repeats, secret_ledger, token_output, winnow
from leafmine.llm.scratch import Scratch


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies. It is looked up on the driver; executors have it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], turns.schema)
    scratch = Scratch(spark, "chat")
    packed, leaves = chat_tree.tree(turns.unionByName(extra), scratch)
    return chat_tree.digests(chat_tree.read_back(packed, leaves, scratch))


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Scratch(spark, 'tokens').root}/files"
    token_output.write(_read(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"))
    return token_output.read(spark.read.schema(token_output.SEGMENT).parquet(path))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = jaccard_join.near_groups(_read(spark, sf_dir, "documents"))
    as_id = lambda c: F.when(F.col(c) != -(1 << 63), F.col(c))
    return groups.select(as_id("k0").alias("doc_id"), "n_shingles", as_id("component").alias("component_id"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "n_words", "similarity")


def op5_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_ledger.versions(_read(spark, sf_dir, "documents"))
    scratch = Scratch(spark, "ledger")
    ledger = scratch.write(secret_ledger.empty_ledger(spark), "ledger")
    ledger = scratch.write(secret_ledger.scan_unseen(found, ledger), "ledger-1")
    text = lambda f: F.format_string("%s:%d:%d", f["kind"], f["start"], f["end"])
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long")
    base = F.filter("findings", lambda f: f["kind"].isin(*secret_ledger.BASE))
    return secret_ledger.by_path(found, ledger).select(
        F.col("path").cast("long").alias("doc_id"),
        *[count(k).alias(f"n_{k}") for k in secret_ledger.BASE],
        F.sha2(F.array_join(F.transform(base, text), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("findings", text), ",").alias("spans"),
    )


def op6_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = winnow.edited_fingerprints(_read(spark, sf_dir, "documents"))
    return both.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next", "places")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = quality.train(docs, _read(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.remove_lines(_read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repeats.remove_repeats(_read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    found = language.identify(docs, language.train(docs))
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_read(spark, sf_dir, "documents")).withColumnRenamed("proof", "proof_sha256")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(_read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_chat_tree, op2_token_output, op3_jaccard_join, op4_decontaminate, op5_secret_ledger, op6_winnow, op7_quality, op8_mix, op9_line_dedup, op10_repeats, op11_language, op12_merkle, op13_hard_negatives)
}

_ESCAPED = r"regexp_replace(regexp_replace(replace({0}, '\', '\\'), '<(/?s>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g')"
# CRC-32 of the id's digits, bit by bit.
_CRC = """xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(string_split(cast(doc_id as varchar), ''), lambda ch: cast(ascii(ch) as bigint))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), cast([0, 0, 0, 0, 0, 0, 0, 0] as bigint[])), lambda x, z: xor(x >> 1, case when x & 1 = 1 then 3988292384 else 0 end))), 4294967295)"""

SQL: dict[str, str] = {
    "op1_chat_tree": f"""
        with t as (
            select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations
            union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]')
        select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) turns_sha256,
            cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) loss_chars,
            sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) loss_sha256,
            cast(sum(17 + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")})) as bigint) formatted_chars
        from t group by conv_id""",
    "op4_decontaminate": r"""
        with dw as (select doc_id, t, list_filter(string_split_regex(lower(t), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from (select doc_id, coalesce(text, '') t from documents)),
        iw as (select row_number() over () item, * from (select distinct item_id, list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from benchmark) where len(w) >= 5),
        ig as (select item, len(w) n, i k, array_to_string(w[i + 1 : i + 5], ' ') gram from iw, unnest(range(0, len(w) - 4)) u(i)),
        dg as (select doc_id, t, i, array_to_string(w[i + 1 : i + 5], ' ') gram from dw, unnest(range(0, len(w) - 4)) u(i) where len(w) >= 5),
        win as (select distinct doc_id, t, item, n, greatest(i - k, 0) s from dg join ig using (gram)),
        wg as (select win.doc_id, win.t, item, n, s, gram, count(*) cw from win join dg on dg.doc_id is not distinct from win.doc_id and dg.t = win.t and dg.i >= s and dg.i + 5 <= s + n group by all),
        c as (select item, gram, count(*) ci from ig group by all),
        wt as (select gram, cast(round(1000 * ln(1 + (select count(*) from iw) / count(*))) as bigint) weight from c group by gram),
        ti as (select item, sum(ci * weight) ti from c join wt using (gram) group by item),
        m as (select doc_id, t, wg.item, n, s, sum(cw * coalesce(weight, cast(round(1000 * ln(1 + (select count(*) from iw))) as bigint))) tw, sum(least(cw, coalesce(ci, 0)) * coalesce(weight, 0)) b
            from wg left join wt using (gram) left join c on c.item = wg.item and c.gram = wg.gram group by all),
        r as (select doc_id, t, item_id, s, n, b, tw + ti - b e from m join ti using (item) join iw using (item) where 100 * b >= 75 * (tw + ti - b))
        select doc_id, item_id, cast(s as int) "start", cast(n as int) n_words, cast(b as double) / cast(e as double) similarity from r
        qualify row_number() over (partition by doc_id, t, item_id order by cast(b as double) / cast(e as double) desc, s, n) = 1""",
    "op8_mix": r"""
        with x as (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) size,
                cast(('0x' || substr(md5(coalesce(cast(doc_id as varchar), 'null')), 1, 8)) as bigint) h from documents),
        s as (select source, cast(sum(size) as bigint) source_size from x group by source),
        a as (select *, cast([5, 2, 1][cast((row_number() over (order by source asc nulls last) - 1) % 3 + 1 as int)] as double) w, cast(2 * source_size as double) most from s),
        b as (select *, sum(source_size) over () * cast(1.5 as double) budget, sum(w) over () all_w,
                coalesce(sum(most) over (order by most / w, source asc nulls last rows between unbounded preceding and 1 preceding), 0) filled,
                coalesce(sum(w) over (order by most / w, source asc nulls last rows between unbounded preceding and 1 preceding), 0) filled_w from a),
        c as (select *, (budget - filled) / (all_w - filled_w) lev from b),
        d as (select *, max(case when lev * w < most then lev end) over () best from c),
        e as (select source, source_size, case when lev * w < most then best * w else most end target from d),
        f as (select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end whole from e),
        g as (select x.doc_id, x.size, f.source_size, f.target, f.whole, floor(f.target) - f.whole * f.source_size rest,
                sum(x.size) over (partition by x.source order by x.h) run, sum(x.size) over (partition by x.source, x.h) own from x join f on x.source is not distinct from f.source)
        select doc_id, size, source_size, target, cast(size * (whole + case when (run <= rest or run - rest < rest - (run - own)) and whole < 2 then 1 else 0 end) as bigint) taken from g""",
    "op9_line_dedup": r"""
        with d as (select doc_id, coalesce(text, '') t, string_split(coalesce(text, ''), chr(10)) l from documents),
        w as (select doc_id, t, i, least(3, len(l)) n, array_to_string(l[i + 1 : i + least(3, len(l))], chr(10)) win from d, unnest(range(0, len(l) - least(3, len(l)) + 1)) u(i)),
        f as (select doc_id, t, i, n, rank() over (partition by n, win order by doc_id nulls first, t, i) r from w where regexp_matches(win, '\S')),
        g as (select distinct doc_id, t, unnest(range(i, i + n)) j from f where r > 1),
        k as (select d.doc_id, d.t, len(d.l) n_lines, j.j, g.j is not null gone, d.l[j.j + 1] line
            from d cross join unnest(range(0, len(d.l))) j(j) left join g on g.doc_id is not distinct from d.doc_id and g.t = d.t and g.j = j.j)
        select doc_id, n_lines, count(*) filter (where gone) n_removed, sha256(coalesce(string_agg(line, chr(10) order by j) filter (where not gone), '')) kept_sha256
        from k group by doc_id, t, n_lines""",
    "op12_merkle": r"""
        with recursive f as (select doc_id, source, text, case when doc_id is null then '-' else octet_length(encode(cast(doc_id as varchar))) || ':' || doc_id end || case when source is null then '-' else octet_length(encode(source)) || ':' || source end
                || case when lang is null then '-' else octet_length(encode(lang)) || ':' || lang end || case when n_chars is null then '-' else octet_length(encode(cast(n_chars as varchar))) || ':' || n_chars end head,
                replace(text, chr(10), '') less from documents),
        b as (select doc_id, source, sha256(head || case when text is null then '-' else octet_length(encode(text)) || ':' || text end) leaf, sha256(head || case when less is null then '-' else octet_length(encode(less)) || ':' || less end) other from f),
        c as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 r, row_number() over () id from b),
        low as (
            select 0 l, source, r, leaf h, count(*) over (partition by source) n from c
            union all select l + 1, source, r // 3, sha256(string_agg(h, '' order by r)), (n + 2) // 3 from low where n > 1 group by l, source, r // 3, n),
        subs as (select source, h sub, row_number() over (order by source nulls first) - 1 s from low where n = 1),
        high as (
            select 0 l, s r, sub h, count(*) over () n from subs
            union all select l + 1, r // 3, sha256(string_agg(h, '' order by r)), (n + 2) // 3 from high where n > 1 group by l, r // 3, n),
        path as (
            select id, l, coalesce(string_agg(h, '' order by low.r) filter (where low.r < c.r // cast(3**l as bigint)), '') p, coalesce(string_agg(h, '' order by low.r) filter (where low.r > c.r // cast(3**l as bigint)), '') q
            from c join low on low.source is not distinct from c.source and low.r // 3 = c.r // cast(3**(l + 1) as bigint) where n > 1 group by id, l
            union all
            select id, 1000 + l, coalesce(string_agg(h, '' order by high.r) filter (where high.r < s // cast(3**l as bigint)), ''), coalesce(string_agg(h, '' order by high.r) filter (where high.r > s // cast(3**l as bigint)), '')
            from c join subs on subs.source is not distinct from c.source join high on high.r // 3 = s // cast(3**(l + 1) as bigint) where n > 1 group by id, l),
        steps as (select id, list(struct_pack(p := p, q := q) order by l) e from path group by id),
        t as (select c.*, case when doc_id is not null and {crc} % 2 = 0 then other else leaf end changed, coalesce(e, []) e from c left join steps using (id)),
        g as (select id, 0 k, changed acc from t union all select g.id, k + 1, sha256(e[k + 1].p || acc || e[k + 1].q) from g join t using (id) where k < len(e))
        select doc_id, leaf, sub subroot, (select h from high where n = 1) root, sha256(array_to_string(list_transform(e, lambda x: x.p || x.q), '')) proof_sha256, acc folded_root, acc = (select h from high where n = 1) verified
        from t join subs on subs.source is not distinct from t.source join g on g.id = t.id and k = len(e)""".replace("{crc}", _CRC),
    "op13_hard_negatives": r"""
        with x as (select vec_id, cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as bigint) label, list_transform(embedding, lambda y: floor(256 * cast(y as double))) v from embeddings
            where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda y: y is null or not isfinite(y))) = 0),
        v as (select distinct on (vec_id) * from x order by vec_id, label, v),
        s as (select a.vec_id a, r.vec_id r, a.label = r.label same, cast(list_dot_product(a.v, r.v) as bigint) score from v a join v r on a.vec_id % 100 = 0 and a.vec_id <> r.vec_id),
        p as (select * from s where same qualify row_number() over (partition by a order by score desc, r) <= 5),
        n as (select p.a, p.r positive, p.score positive_score, s.r negative, s.score negative_score, row_number() over (partition by p.a, p.r order by s.score desc, s.r) k
            from p join s on p.a = s.a and not s.same and 80 * p.score <= 100 * s.score and s.score <= p.score)
        select a anchor_id, positive positive_id, cast(k as int) rank, negative negative_id, positive_score, negative_score from n where k <= 5""",
}
