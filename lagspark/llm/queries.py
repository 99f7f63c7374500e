"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import chat, exact_dup, licenses, lm, mixing, near_dup, packing, quality, secrets, warc
from .shared import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents")).drop("class_id")


NEAR_SQL = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(len(w) - 4), lambda i: array_to_string(w[(i + 1)::int:(i + 5)::int], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from d),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 75 * (nx.n + ny.n - c)),
both_ways as (select x, y from l union all select y, x from l),
r(doc, lab) as (select doc_id, doc_id from n union select y, lab from r join both_ways on doc = x),
m as (select doc, min(lab) as lab from r group by 1)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(lab, d.doc_id) as component_id, coalesce(lab, d.doc_id) = d.doc_id as kept
from d left join n on n.doc_id = d.doc_id left join m on m.doc = d.doc_id
"""


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    path = Scratch(spark, "warc").path("archives")
    warc.write(pages, path)
    return warc.read(spark, path).drop("intact")


WARC_SQL = r"""
with p as (select page_id, coalesce(html, '') as t from pages),
h as (select page_id, strlen(t) as n, sha1(t) as hex from p),
d as (select *, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((list_aggregate(list_transform(range(5), lambda j: (strpos('0123456789abcdef', substr(hex, ((i // 4) * 5 + j + 1)::int, 1)) - 1) * (16 ** (4 - j))::bigint), 'sum')::bigint
      >> (15 - 5 * (i % 4))::int) & 31)::int + 1, 1)), 'string_agg', '') as digest from h),
f as (select *, max(page_id) over (partition by hex, n) as keep from d)
select page_id, n as payload_bytes, digest as payload_digest,
  case when keep is not null and page_id is distinct from keep then 'revisit' else 'response' end as record_type,
  case when keep is not null and page_id is distinct from keep then keep end as refers_to from f
"""


def op3_exact_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dup.decisions(_table(spark, sf_dir, "documents")).drop("h")


EXACT_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as n from documents),
g as (select *, first_value(doc_id) over (partition by n order by length(t) desc, doc_id) as keep_id, count(*) over (partition by n) as group_size from d)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(n) as text_sha256 from g
"""


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.train(docs, _table(spark, sf_dir, "labels")))


def _either(word: str) -> str:
    """A pattern of ASCII letters in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_ASSIGN = "(" + "|".join(_either(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
#: Matches and what is between them alternate, which gives every match its place.
SECRETS_SQL = " union all ".join(f"select rid, {k} as k, '{name}' as kind, {least} as least, regexp_extract_all(t, '{pattern}') as f, regexp_extract_all(t, '{pattern}', {group}) as v, string_split_regex(t, '{pattern}') as g from d" for k, (name, least, group, pattern) in enumerate((("assign", secrets.ASSIGN_LEAST, 2, _ASSIGN), ("access", secrets.ACCESS_LEAST, 0, "AKIA[A-Z0-9]+"), ("hex", secrets.HEX_LEAST, 0, "[0-9a-f]+"))))
SECRETS_SQL = f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
m as ({SECRETS_SQL}),
s as (select *, unnest(range(1, len(f) + 1)) as i from m where len(f) > 0),
p as (select rid, k, kind, list_sum(list_transform(g[1:i::int], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:(i - 1)::int], lambda x: length(x))), 0) as a, length(f[i]) as n from s where length(v[i]) >= least),
c as (select rid, count(*) filter (k = 0) as n_assign, count(*) filter (k = 1) as n_access, count(*) filter (k = 2) as n_hex, string_agg(kind || ':' || a::bigint || ':' || (a + n)::bigint, ',' order by a, k) as spans from p group by 1)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex, sha256(coalesce(spans, '')) as base_sha256 from d left join c using (rid)
"""


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op4_secrets that SQL can express."""
    return op4_secrets(spark, sf_dir).drop("spans")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    # covered_words and longest_repeat are facts of the method; the first and the verdict have SQL.
    return quality.rules(_table(spark, sf_dir, "documents")).drop("longest_repeat")


#: The union of repeats of five words or more is that of five-word windows found twice;
#: a repeat of over 100 words is a window of 101 found twice.
QUALITY_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
i as (select doc_id, w, unnest(range(1, len(w) + 1)) as i, len(w) as n from d),
g as (select doc_id, i, case when i + 2 <= n then hash(w[i::int:(i + 2)::int]) end as g3, case when i + 4 <= n then hash(w[i::int:(i + 4)::int]) end as g5, case when i + 100 <= n then hash(w[i::int:(i + 100)::int]) end as g101 from i),
c as (select doc_id, i, g3 is not null and count(*) over (partition by doc_id, g3) > 1 as r3, g5 is not null and count(*) over (partition by doc_id, g5) > 1 as r5, g101 is not null and count(*) over (partition by doc_id, g101) > 1 as r101 from g),
v as (select doc_id, bool_or(r3) over w3 as c3, bool_or(r5) over w5 as c5, r101 from c window w3 as (partition by doc_id order by i rows between 2 preceding and current row), w5 as (partition by doc_id order by i rows between 4 preceding and current row)),
a as (select doc_id, sum(c3::int)::bigint as n3, sum(c5::int)::bigint as n5, bool_or(r101) as lng from v group by 1),
k as (select doc_id, unnest(string_split(t, chr(10))) as line from d),
u as (select doc_id, (count(*) - count(distinct line))::bigint as dup from k where regexp_matches(line, '[^\x20\x09-\x0D]') group by 1),
b as (select d.doc_id, len(w)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
  coalesce(dup, 0)::bigint as n_dup_lines, coalesce(n3, 0)::bigint as n_repeat_words, coalesce(n5, 0)::bigint as covered_words, coalesce(lng, false) as lng from d left join a using (doc_id) left join u using (doc_id)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and 100 * covered_words <= 40 * n_words and not lng as kept, covered_words from f
"""


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"), rescan=True)


#: '' is the end and ' ' the beginning, neither being a word.
LM_SQL = rf"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w,
    xor(4294967295, list_reduce([4294967295] || list_transform(string_split(coalesce(doc_id::varchar, ''), ''), lambda c: case when c = '' then null else ascii(c)::bigint end),
      lambda a, b: case when b is null then a else list_reduce([xor(a, b)] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) end)) % {lm.MODULUS} = {lm.HELD_OUT} as held from documents),
i as (select rid, held, w, unnest(range(1, len(w) + 2)) as i from d),
t as (select rid, held, case when i <= len(w) then w[i] else '' end as x, case when i = 1 then ' ' else w[i - 1] end as h1, case when i = 2 then ' ' when i > 2 then w[i - 2] end as h2 from i),
u as (select x, count(*) as c1 from t where not held group by 1),
n as (select sum(c1) as n, count(*) as v from u),
b as (select h1, x, count(*) as c2 from t where not held group by 1, 2),
bh as (select h1, sum(c2) as s1 from b group by 1),
g as (select h2, h1, x, count(*) as c3 from t where not held and h2 is not null group by 1, 2, 3),
gh as (select h2, h1, sum(c3) as s2 from g group by 1, 2),
p as (select rid, c1, (coalesce(c1, 0) + 1) / (n + v + 1)::double as p1, coalesce(c2, 0) as c2, coalesce(s1, 0) as s1, coalesce(c3, 0) as c3, coalesce(s2, 0) as s2, t.h2 from t cross join n
  left join u on u.x = t.x left join b on b.h1 = t.h1 and b.x = t.x left join bh on bh.h1 = t.h1
  left join g on g.h2 = t.h2 and g.h1 = t.h1 and g.x = t.x left join gh on gh.h2 = t.h2 and gh.h1 = t.h1),
q as (select *, (c2 + {lm.PRIORS[0]}::double * p1) / (s1 + {lm.PRIORS[0]}::double) as p2 from p),
s as (select rid, count(*) as n_tokens, count(c1) as n_known, fsum(log10(p1)) as base, fsum(log10(case when h2 is null then p2 else (c3 + {lm.PRIORS[1]}::double * p2) / (s2 + {lm.PRIORS[1]}::double) end)) as score from q group by 1)
select doc_id, held as held_out, n_tokens, n_known, n::bigint as train_tokens, round(base, 6) as base_score, round(score, 6) as score from d join s using (rid) cross join n
"""


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), row=F.lit(None).cast("int"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


MIX_SQL = r"""
with lab as (select doc_id, max(quality) as q from labels where doc_id is not null group by 1),
d as (select d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
        1 - pow((('0x' || substr(md5(coalesce(d.doc_id::varchar, 'null')), 1, 13))::bigint + 0.5::double) / 4503599627370496::double,
                1 / (case when q > 0 then 2.0::double when q <= 0 then 0.5::double else 1.0::double end)) as key
      from documents d left join lab on d.doc_id = lab.doc_id),
s as (select source, sum(size)::bigint as source_size from d group by 1),
r as (select *, [5.0::double, 2.0, 1.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as w, 3 * source_size as cap from s),
c as (select *, (sum(source_size) over ())::double - coalesce(sum(cap) over b, 0)::double as lft, sum(w) over () - coalesce(sum(w) over b, 0) as left_w
      from r window b as (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding)),
f as (select *, cap * left_w < w * lft as is_full from c),
l as (select *, min_by({'a': lft, 'b': left_w}, case when not is_full then cap / w end) over () as lev from f),
t as (select source, source_size, case when is_full then cap::double else w * lev.a / lev.b end as target from l),
e as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as epochs from t),
p as (select d.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size as rest,
        coalesce(sum(size) over (partition by d.source order by key, doc_id rows between unbounded preceding and 1 preceding), 0) as ahead
      from d join e on d.source is not distinct from e.source)
select doc_id, size, source_size, target, (size * case when size > 0 then epochs + (ahead + size / 2 <= rest)::int else 0 end)::bigint as taken from p
"""


def queries() -> dict:
    return {"op1_near_dup": op1_near_dup, "op2_warc": op2_warc, "op3_exact_dup": op3_exact_dup, "op4_secrets": op4_secrets, "op5_licenses": op5_licenses, "op6_quality": op6_quality, "op7_packing": op7_packing, "op8_chat_format": op8_chat_format, "op9_lm_score": op9_lm_score, "op10_mixing": op10_mixing, "secrets_base": secrets_base}


def oracle_sql() -> dict[str, str]:
    return {"op1_near_dup": NEAR_SQL, "op2_warc": WARC_SQL, "op3_exact_dup": EXACT_SQL, "op6_quality": QUALITY_SQL, "op9_lm_score": LM_SQL, "op10_mixing": MIX_SQL, "secrets_base": SECRETS_SQL}
