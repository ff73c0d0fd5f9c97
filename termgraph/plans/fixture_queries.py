"""Queries over literal rows, for operators on Korean text: the driver's tables have no Hangul."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termgraph import vocab
from termgraph.functions import text as T
from termgraph.operators import citations, cooccur, dedup, entities, hierarchy, nouns, promotion, rdf, relations, typing
from termgraph.plans.registry import case, query, values

S = SparkSession


def tokens(c: str = "tokens") -> Column:
    """``form/TAG form/TAG`` as an array of tokens laid end to end; NULL stays NULL."""
    parts = F.filter(F.split(c, " "), lambda x: x != "")
    form = lambda x: F.get(F.split(x, "/"), F.lit(0))
    before = lambda i: F.aggregate(F.slice(parts, 1, i), F.lit(0), lambda a, x: a + F.length(form(x)))
    return F.transform(parts, lambda x, i: F.struct(form(x).alias("form"), F.get(F.split(x, "/"), F.lit(1)).alias("tag"), before(i).alias("start"), F.length(form(x)).alias("len")))


def _in(words: frozenset[str]) -> str:
    return ", ".join(f"'{w}'" for w in sorted(words))


LABELS = values("label", ", ".join(f"('{x}')" for x in "서울|서울서울|서울서울서울|대한대한|년_1월|1세기|20년대|년대|___|0.5|a|ho|pi|Ur|SI|PS2|An-26|Fe|Boeing 747|고려 892|North Rhine -|(서울|서울시|“서울|. Michael|rock|가|가나|Ⅳ②|ab12|É1|éa|초분|기원전".split("|")))


@query(f"""WITH t AS ({LABELS}), x AS (SELECT label, trim(label) AS c, array_to_string(regexp_extract_all(label, '[\\p{{L}}\\p{{Nl}}\\p{{No}}]'), '') AS letters FROM t)
SELECT label, NOT (length(letters) < 2 OR (length(c) >= 6 AND length(c) % 2 = 0 AND c[:length(c) // 2] = c[length(c) // 2 + 1:])
  OR regexp_full_match(letters, '(?:기원전|기원후|년대|세기|연도|년|월|일|시|분|초)+') OR regexp_matches(c, '[()\\[\\]{{}}]|^["“”''‘’]|[‘’''“”"]$|^[.,:;-]|[!,:;-]$')
  OR (contains(c, ' ') AND regexp_matches(c, '[가-힣]') AND regexp_matches(c, '(?:^|\\s)\\d+(?:\\s|$)'))
  OR (NOT regexp_matches(c, '[가-힣一-鿿]') AND ((length(c) = 2 AND regexp_full_match(c, '[A-Za-z]\\pL') AND NOT (c = upper(c)))
    OR (regexp_matches(regexp_extract(c, '[A-Za-z]'), '[a-z]') AND list_max(list_transform(regexp_extract_all(c, '[\\p{{L}}\\p{{Nl}}\\p{{No}}]+'), lambda w: length(w))) <= 2)))) AS fits FROM x""")
def label_gate(spark: S, d: str) -> DataFrame:
    """COO-1."""
    return spark.sql(LABELS).select("label", cooccur.label_fits("label").alias("fits"))


_KLABELS = values("label, tokens", "('인천이', '인천/NNP 이/JKS'), ('것', '것/NNB'), ('이것', '이것/NNB'), ('국회의', '국회/NNG 의/JKG'), ('보험업', '보험/NNG 업/XSN'), ('영국', NULL), ('Paris', NULL)")


@query(f"WITH t AS ({_KLABELS}) SELECT label, length(label) > 1 AND NOT (coalesce(regexp_full_match(tokens, '\\S+/NNB'), false) OR coalesce(regexp_matches(tokens, '/J\\w*$'), false)) AS fits FROM t")
def korean_label_gate(spark: S, d: str) -> DataFrame:
    """COO-2."""
    return spark.sql(_KLABELS).select("label", cooccur.korean_label_fits("label", tokens()).alias("fits"))


_GATES = values(
    "id, label, s_class, o_class, obj, sentence",
    ", ".join(
        f"({i}, {r})"
        for i, r in enumerate(
            [
                "'per:title', '기관', '용어', '사장', '홍길동 사장'", "'org:product', '인물', '인공물', '전화', '전화 출시'", "'org:founded', '지역', '날짜', '1948년', '1948년 설립'", "'org:founded', '기관', '날짜', '올해', '올해 설립'",
                "'org:founded', '기관', '날짜', '3개월 동안', '설립'", "'org:founded_by', '기관', '지역', '서울', '서울에서 설립'", "'org:founded_by', '기관', '인물', '홍길동', '홍길동이 세웠다'", "'org:founded_by', '기관', '인물', '홍길동', '홍길동이 왔다'",
                "'per:religion', '인물', '기관', '불교', '불교 신자'", "'per:spouse', '미상', '기타', '영희', '영희와 결혼'", "'org:dissolved', '기관', '날짜', '2001년', '문을 닫았다'", "'per:origin', NULL, NULL, '한국', '한국 출신'",
                "'org:members', '기관', '기관', '지난달', '산하'", "'org:members', '기관', '기관', '2 분기', '산하'", "'org:members', '기관', '기관', '두 달 뒤', '산하'",
            ]
        )
    ),
)


def _gate_sql() -> str:
    allow = " ".join(f"WHEN '{k}' THEN [{_in(v)}]" for k, v in vocab.OBJECT_CLASSES.items())
    cues = " ".join(f"WHEN '{k}' THEN [{_in(v)}]" for k, v in vocab.TRIGGERS.items())
    return f"""WITH t AS ({_GATES}), x AS (SELECT *, CASE label {allow} END AS allowed, CASE label {cues} END AS cues FROM t)
SELECT id, CASE WHEN label LIKE 'per:%' AND s_class IN ({_in(vocab.KNOWN_CLASSES)}) AND s_class <> '인물' THEN 'S' WHEN label LIKE 'org:%' AND s_class IN ({_in(vocab.KNOWN_CLASSES)}) AND s_class NOT IN ('기관', '지역') THEN 'S'
  WHEN regexp_full_match(trim(obj), '{vocab.RELATIVE_TIME}') THEN 'T' WHEN allowed IS NOT NULL AND o_class IN ({_in(vocab.KNOWN_CLASSES)}) AND NOT list_contains(allowed, o_class) THEN 'O'
  WHEN cues IS NOT NULL AND len(list_filter(cues, lambda c: contains(sentence, c))) = 0 THEN 'G5' END AS reason FROM x"""


@query(_gate_sql())
def gate_reason(spark: S, d: str) -> DataFrame:
    """REL-9."""
    return spark.sql(_GATES).select("id", relations.gate_reason("label", "s_class", "o_class", "obj", "sentence").alias("reason"))


_MARKS = values("id, sentence, s, o", "(0, '금호고속 이덕연 사장', '금호고속', '이덕연'), (1, '이덕연 사장은 금호고속 대표', '금호고속', '이덕연'), (2, '서울특별시', '서울', '서울특별시'), (3, '서울에 갔다', '서울', '부산'), (4, '가나가나다', '가나', '다')")


@query(f"""WITH t AS ({_MARKS}), x AS (SELECT *, instr(sentence, s) AS a, instr(sentence, o) AS b, length(s) AS n, length(o) AS m FROM t)
SELECT id, CASE WHEN a > 0 AND b > 0 AND a + n <= b THEN substr(sentence, 1, a - 1) || ' [S:ORG] ' || s || ' [/S] ' || substr(sentence, a + n, b - a - n) || ' [O:PER] ' || o || ' [/O] ' || substr(sentence, b + m)
 WHEN a > 0 AND b > 0 AND b + m <= a THEN substr(sentence, 1, b - 1) || ' [O:PER] ' || o || ' [/O] ' || substr(sentence, b + m, a - b - m) || ' [S:ORG] ' || s || ' [/S] ' || substr(sentence, a + n) END AS marked FROM x""")
def marker_insert(spark: S, d: str) -> DataFrame:
    """REL-8."""
    return spark.sql(_MARKS).select("id", relations.marked("sentence", "s", F.lit("ORG"), "o", F.lit("PER")).alias("marked"))


_SPANS = values(
    "id, text, s, e",
    ", ".join(f"({i}, {r})" for i, r in enumerate(["'서울은 크다', 0, 2", "'서울시는 크다', 0, 2", "'반정부 시위', 1, 3", "'학생들은 갔다', 0, 2", "'학생들 갔다', 0, 2", "'1998년에', 0, 4", "'183년', 0, 2", "'손정의', 0, 2", "'한국에서는', 0, 2", "'한국abc', 0, 2", "'12kg', 0, 2", "'서울', 0, 2", "'서울', NULL, NULL", "'서울', 1, 9", "'바다이었다', 0, 2", "'나라도', 0, 1"])),
)
_JOSA = "|".join(sorted(vocab.PARTICLES, key=lambda p: (-len(p), p)))


@query(f"""WITH t AS ({_SPANS}), x AS (SELECT *, substr(text, s, 1) AS l, substr(text, e + 1, 1) AS r, regexp_extract(substr(text, e + 1), '^[가-힣]+') AS run, regexp_full_match(substr(text, s + 1, e - s), '[0-9][0-9.,\\s]*') AS num FROM t)
SELECT id, CASE WHEN s IS NULL OR NOT (s >= 0 AND s < e AND e <= length(text)) THEN true WHEN s > 0 AND regexp_matches(l, '[가-힣0-9A-Za-z]') THEN false WHEN e >= length(text) THEN true
 WHEN regexp_matches(r, '[가-힣]') THEN num OR regexp_full_match(run, '(?:들)?(?:{_JOSA})*') WHEN regexp_matches(r, '[0-9A-Za-z]') THEN num AND NOT regexp_matches(r, '[0-9]') ELSE true END AS ok FROM x""")
def span_gate(spark: S, d: str) -> DataFrame:
    """NER-8."""
    return spark.sql(_SPANS).select("id", entities.border_ok("text", "s", "e").alias("ok"))


_AUX = values("id, entity, class", ", ".join(f"({i}, '{e}', '{c}')" for i, (e, c) in enumerate([("-서울", "지역"), ("서울)", "지역"), ("a De 서울", "인물"), ("ab", "인물"), ("5th 서울", "사건"), ("3 a서울", "사건"), ("MHKs", "기관"), ("Paris", "지역"), ("5년", "날짜"), ("1998년", "날짜"), ("키예어", "기관"), ("키예어", "용어"), ("서울", "지역"), ("", "지역")])))


@query(f"""WITH t AS ({_AUX}) SELECT id, NOT (entity = '' OR regexp_matches(entity, '^[^\\pL\\pN]|[^\\pL\\pN]$') OR regexp_full_match(string_split(entity, ' ')[1], '[a-z][A-Za-z]*') OR regexp_full_match(entity, '[A-Za-z]{{1,2}}')
 OR regexp_matches(entity, '^\\d+\\s*(?:th|st|nd|rd)\\b') OR regexp_matches(entity, '^\\d+\\s+[a-z]') OR regexp_full_match(entity, '[A-Z]{{2,}}s') OR NOT regexp_matches(entity, '[가-힣]') OR regexp_full_match(entity, '[0-9]{{1,2}}년') OR (entity LIKE '%어' AND class = '기관')) AS ok FROM t""")
def aux_gate(spark: S, d: str) -> DataFrame:
    """NER-5."""
    return spark.sql(_AUX).select("id", entities.aux_ok("entity", "class").alias("ok"))


_RAW = values("chunk_id, word, entity_group, score, start, end_", "('a', '삼성##전자', 'OG', 0.98765, 0, 4), ('a', '김', 'PS', 0.9, 5, 6), ('a', '서울', 'LC', 0.28, 7, 9), ('a', '2020', 'MISC', 0.8, 10, 14), ('a', 'Rome', 'LOC', 0.7, 15, 19), ('b', '도쿄', 'ZZ', CAST(NULL AS DOUBLE), 0, 2), ('b', 'New Age', 'MISC', 0.9, 3, 10)")


def _raw(spark: S) -> DataFrame:
    return spark.sql(_RAW.replace("end_", "`end`")).withColumn("score", F.col("score").cast("double"))


@query(f"""WITH t AS ({_RAW}), w AS (SELECT *, replace(word, '##', '') AS e, CASE entity_group WHEN 'OG' THEN '기관' WHEN 'PS' THEN '인물' WHEN 'LC' THEN '지역' ELSE entity_group END AS ko, CASE entity_group WHEN 'LOC' THEN '지역' ELSE entity_group END AS en FROM t)
SELECT 'ko' AS model, chunk_id, e AS entity, ko AS class, CAST(round(coalesce(score, 1.0), 4) AS DOUBLE) AS score FROM w WHERE length(e) >= 2 AND coalesce(score, 1.0) >= 0.4
UNION ALL SELECT 'en', chunk_id, e, en, NULL FROM w WHERE length(e) >= 2 AND regexp_matches(e, '\\pL') AND entity_group <> 'MISC'""")
def ner_records(spark: S, d: str) -> DataFrame:
    """NER-1, NER-4: model output as records."""
    ko, en = entities.korean_records(_raw(spark)), entities.english_records(_raw(spark))
    return ko.withColumn("model", F.lit("ko")).unionByName(en.withColumn("model", F.lit("en"))).select("model", "chunk_id", "entity", "class", "score")


_BASE = values("chunk_id, ord, entity, class", "('a', 0, '삼성 전자', '기관'), ('b', 0, '서울', '지역')")
_MORE = values("chunk_id, ord, entity, class", "('a', 0, '삼성전자', '기관'), ('a', 1, '한국 은행', '기관'), ('a', 2, '한국은행', '기관'), ('b', 0, 'Paris', '지역'), ('b', 1, '부산', '지역'), ('a', 3, '서울', '지역')")


@query(f"""WITH b AS ({_BASE}), m AS ({_MORE}) SELECT chunk_id, ord, entity, class FROM b UNION ALL SELECT chunk_id, ord, entity, class FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id, replace(entity, ' ', '') ORDER BY ord) AS n FROM m
 WHERE regexp_matches(entity, '[가-힣]') AND NOT EXISTS (SELECT 1 FROM b WHERE b.chunk_id = m.chunk_id AND replace(b.entity, ' ', '') = replace(m.entity, ' ', ''))) WHERE n = 1""")
def ner_union(spark: S, d: str) -> DataFrame:
    """NER-6."""
    return entities.united(spark.sql(_BASE), spark.sql(_MORE))


_NOUNS = values("chunk_id, tokens", "('a', '생명/NNG 보험/NNG 업/NNG 은/JX 보험/NNG 이/VCP 다/EF'), ('b', '서울/NNP 은/JX 경우/NNG 에/JKB 서울/NNP'), ('c', '하나/NNG 둘/NNG 셋/NNG 넷/NNG 다섯/NNG 이/JKS'), ('d', '은행/NNG 과/JC 금융/NNG 회사/NNG')")


@query(f"""WITH t AS ({_NOUNS}), w AS (SELECT chunk_id, unnest(x) AS tok, generate_subscripts(x, 1) AS pos FROM (SELECT chunk_id, string_split(tokens, ' ') AS x FROM t)), m AS (SELECT chunk_id, pos, string_split(tok, '/')[1] AS form, string_split(tok, '/')[2] AS tag FROM w),
i AS (SELECT *, sum(CASE WHEN tag IN ('NNG', 'NNP') THEN 0 ELSE 1 END) OVER (PARTITION BY chunk_id ORDER BY pos) AS island FROM m), r AS (SELECT chunk_id, min(pos) AS pos, string_agg(form, '' ORDER BY pos) AS name, count(*) AS n, bool_or(tag = 'NNP') AS proper FROM i WHERE tag IN ('NNG', 'NNP') GROUP BY chunk_id, island)
SELECT DISTINCT chunk_id, name FROM r WHERE length(name) BETWEEN 2 AND 20 AND n <= 4 AND (n > 1 OR proper) AND name NOT IN ({_in(vocab.STOP_KO)})""")
def korean_nouns(spark: S, d: str) -> DataFrame:
    """MOR-2."""
    return nouns.korean_nouns(spark.sql(_NOUNS).withColumn("tokens", tokens()), ["chunk_id"]).select("chunk_id", F.col("surface").alias("name"))


@case("SELECT * FROM (VALUES ('a', '보험'), ('b', '서울'), ('c', ''), ('d', '금융회사')) AS t(chunk_id, last)")
def korean_last_noun(spark: S, d: str) -> DataFrame:
    """MOR-3."""
    return nouns.last_noun(spark.sql(_NOUNS).withColumn("tokens", tokens()), ["chunk_id"])


_KNAMES = values("name, tokens", "('보험업', '보험업/NNG'), ('생명보험업', '생명/NNG 보험업/NNG'), ('손해보험업', '손해/NNG 보험업/NNG'), ('대한민국', '대한민국/NNP'), ('민국', '민국/NNG'), ('중화민국', '중화민국/NNP'), ('국민', '국민/NNG'), ('문화재대한민국', '문화재/NNG 대한민국/NNP'), ('고등학교대한민국', '고등학교/NNG 대한민국/NNP'), ('주주', '주주/NNG'), ('대주주', '대/XPN 주주/NNG'), ('주주주주', '주주/NNG 주주/NNG'), ('Bank', NULL), ('central bank', NULL)")


@query(f"""WITH t AS ({_KNAMES}), k AS (SELECT lower(name) AS key, name FROM t), e AS (SELECT key, name, substr(key, i) AS up FROM k, range(2, 30) r(i) WHERE i < length(key) AND regexp_matches(key, '[가-힣]')),
p AS (SELECT k.name AS parent, e.name AS child, count(*) OVER (PARTITION BY k.key) AS n FROM e JOIN k ON k.key = up) SELECT parent, child FROM p WHERE n >= 2 AND child <> parent || parent""")
def korean_suffixes(spark: S, d: str) -> DataFrame:
    """HIER-2, HIER-5 by characters."""
    return hierarchy.suffix_hierarchy(spark.sql(_KNAMES))


@case("SELECT * FROM (VALUES ('보험업', '생명보험업'), ('보험업', '손해보험업'), ('주주', '대주주')) AS t(parent, child)")
def korean_suffixes_read(spark: S, d: str) -> DataFrame:
    """HIER-3, HIER-4: at morpheme borders, under common nouns."""
    names = spark.sql(_KNAMES)
    return hierarchy.suffix_hierarchy(names, tokens=names.withColumn("tokens", tokens()))


_QUOTED = values("chunk_id, chunk_text", "('a', '\"대주주\"란 발행주식 총수의 100분의 10 이상을 가진 주주를 말한다'), ('b', '“은행”이란 은행업을 경영하는 법인을 말한다. “대출”은 돈을 빌려 주는 것을 말한다'), ('c', '없다')")
_DEF_RE2 = hierarchy.DEFINED


@query(f"""WITH t AS ({_QUOTED}), f AS (SELECT chunk_id, unnest(regexp_extract_all(chunk_text, '{_DEF_RE2}', 1)) AS child, unnest(regexp_extract_all(chunk_text, '{_DEF_RE2}', 2)) AS body FROM t)
SELECT chunk_id, child, body FROM f WHERE NOT regexp_matches(trim(body), '(?:것|곳|등|때|바|수|자)\\s*$')""")
def quoted_definitions(spark: S, d: str) -> DataFrame:
    """HIER-10."""
    return hierarchy.quoted_definitions(spark.sql(_QUOTED), ["chunk_id"])


_SENTENCES = "named_struct('text', text, 'tokens', tokens)"
_DEFS = values("chunk_id, n, text, tokens", "('a', 0, '강아지', '강아지/NNG'), ('a', 1, '강아지는 개과의 동물이다', '강아지/NNG 는/JX 개과/NNG 의/JKG 동물/NNG 이/VCP 다/EF'), ('b', 0, '위상수학은 수학의 한 분야이다', '위상수학/NNG 은/JX 수학/NNG 의/JKG 한/MM 분야/NNG 이/VCP 다/EF'), ('c', 0, '제목', '제목/NNG'), ('c', 1, '일본은 나라이다', '일본/NNP 은/JX 나라/NNG 이/VCP 다/EF')")
_PHRASES = values("name, tokens", "('동물', '동물/NNG'), ('수학', '수학/NNG'), ('나라', '나라/NNG'), ('분야', '분야/NNG')")


@case("SELECT * FROM (VALUES ('a', '강아지', '동물'), ('b', '위상수학', '수학')) AS t(chunk_id, child, parent)")
def definitional_pairs(spark: S, d: str) -> DataFrame:
    """HIER-6 to HIER-9, HIER-11, HIER-12, TYP-2: the title must be the subject."""
    rows = spark.sql(_DEFS).withColumn("tokens", tokens())
    s = rows.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("n", "text", "tokens"))).alias("p")).select("chunk_id", F.transform("p", lambda x: F.struct(x["text"].alias("text"), x["tokens"].alias("tokens"))).alias("pieces"))
    return hierarchy.definitional_pairs(s, spark.sql(_PHRASES).withColumn("tokens", tokens()), ["chunk_id"]).select("chunk_id", "child", "parent")


_ITEMS = values(
    "name, df, has_rel, has_kid, has_inst, person_dom, tokens, en_tag, wordnet",
    "('', 3, false, false, false, false, NULL, NULL, CAST(NULL AS BOOLEAN)), ('홍길동', 3, false, false, false, true, NULL, NULL, NULL), ('Sunday', 3, false, false, false, true, NULL, NULL, true), ('고립어', 1, false, false, false, false, NULL, NULL, NULL), "
    "('고립어', 1, true, false, false, false, NULL, NULL, NULL), ('서울시서울시', 3, true, false, false, false, NULL, NULL, NULL), ('provide', 3, true, false, false, false, NULL, 'VB', NULL), ('le', 3, true, false, false, false, NULL, 'NN', NULL), "
    "('zork', 3, true, false, false, false, NULL, 'NN', false), ('engine', 3, true, false, false, false, NULL, 'NN', true), ('Steam Engine', 3, true, false, false, false, NULL, 'NN', NULL), ('NATO', 3, true, false, false, false, NULL, NULL, NULL)",
)


@query(f"""WITH t AS ({_ITEMS}) SELECT name, df, has_rel, CASE WHEN name = '' THEN 'shape' WHEN person_dom AND NOT (NOT regexp_matches(name, '[가-힣]') AND coalesce(wordnet, false)) THEN 'person' WHEN NOT (df >= 2 OR has_rel OR has_kid OR has_inst) THEN 'gate'
 WHEN length(name) >= 6 AND length(name) % 2 = 0 AND name[:length(name) // 2] = name[length(name) // 2 + 1:] THEN 'repeat' WHEN regexp_matches(name, '[가-힣]') THEN ''
 WHEN regexp_matches(name, '(?:^| )[A-Z]\\w*$') AND NOT (name = upper(name)) THEN '' WHEN en_tag IS NULL THEN '' WHEN NOT starts_with(en_tag, 'NN') THEN 'shape' WHEN length(name) <= 2 OR (name = lower(name) AND NOT contains(name, ' ') AND length(name) <= 3) THEN 'shape'
 WHEN name = lower(name) AND NOT contains(name, ' ') AND NOT coalesce(wordnet, true) THEN 'shape' ELSE '' END AS reason FROM t""")
def promotion_decide(spark: S, d: str) -> DataFrame:
    """PRO-2, PRO-3, PRO-5."""
    out = promotion.decided(spark.sql(_ITEMS).withColumn("tokens", tokens()), 20_000)
    return out.select("name", "df", "has_rel", F.col("decision.reason").alias("reason"))


_READ = values("name, df, tokens", "('예금', 3, '예금/NNG'), ('빠르게', 3, '빠르/VA 게/EC'), ('전쟁이후', 3, '전쟁/NNG 이후/NNG'), ('해당법인', 3, '해당/NNG 법인/NNG'), ('역사러시아문화연구소장', 2, '역사/NNG 러시아/NNP 문화/NNG 연구소장/NNG')")


@case("SELECT * FROM (VALUES ('예금', ''), ('빠르게', 'shape'), ('전쟁이후', 'relhead'), ('해당법인', 'deictic'), ('역사러시아문화연구소장', 'overjoin')) AS t(name, reason)")
def promotion_decide_read(spark: S, d: str) -> DataFrame:
    """PRO-2, PRO-4: with readings; the second reading is the nominal one."""
    no, yes = F.lit(None).cast("string"), F.lit(False)
    verb = F.array(F.struct(F.lit("하").alias("form"), F.lit("VV").alias("tag"), F.lit(0).alias("start"), F.lit(1).alias("len")))
    rows = spark.sql(_READ).withColumn("tokens", promotion.noun_reading(F.array(verb, tokens()))).withColumns({"tokens": F.when(F.col("name") == "빠르게", tokens_of("빠르/VA 게/EC")).otherwise(F.col("tokens")), "has_rel": yes, "has_kid": yes, "has_inst": yes, "person_dom": yes, "en_tag": no, "wordnet": F.lit(None).cast("boolean")})
    return promotion.decided(rows, 20_000).select("name", F.col("decision.reason").alias("reason"))


def tokens_of(text: str) -> Column:
    """The same from a literal."""
    return F.array(*[F.struct(F.lit(f).alias("form"), F.lit(t).alias("tag"), F.lit(0).alias("start"), F.lit(len(f)).alias("len")) for f, t in (x.split("/") for x in text.split())])


_STEMS = values("stem", "('따르'), ('알리'), ('정하'), ('막'), ('읽'), ('')")


@query(f"WITH t AS ({_STEMS}) SELECT stem, CASE WHEN stem = '' THEN '' WHEN (unicode(stem[-1:]) - 44032) % 28 = 0 THEN stem[:-2] || chr(unicode(stem[-1:]) + 16) ELSE stem || '음' END AS noun FROM t")
def nominal_stems(spark: S, d: str) -> DataFrame:
    """REL-2f."""
    return spark.sql(_STEMS).select("stem", T.nominalise("stem").alias("noun"))


_SVO = [
    ("a", [("금융위원회는 은행을 감독한다.", "금융위원회/NNG/0 는/JX/5 은행/NNG/7 을/JKO/9 감독/NNG/11 하/XSV/13 ᆫ다/EF/14 ./SF/15")]),
    ("b", [("임원은 다음 행위를 하여서는 아니 된다.", "임원/NNG/0 은/JX/2 다음/NNG/4 행위/NNG/7 를/JKO/9 하/VV/11 여서/EC/12 는/JX/14 아니/MAG/16 되/VV/19 ᆫ다/EF/20 ./SF/21"), ("1) 자금을 차입하는 행위", "1/SN/0 )/SSC/1 자금/NNG/3 을/JKO/5 차입/NNG/7 하/XSV/9 는/ETM/10 행위/NNG/12")]),
    ("c", [("은행이 법원에 의하여 해산된다.", "은행/NNG/0 이/JKS/2 법원/NNG/4 에/JKB/6 의하/VV/8 어/EC/10 해산/NNG/12 되/XSV/14 ᆫ다/EF/15 ./SF/16")]),
    ("d", [("회사는 주주의 동의를 받아야 한다.", "회사/NNG/0 는/JX/2 주주/NNG/4 의/JKG/6 동의/NNG/8 를/JKO/10 받/VV/12 어야/EC/13 하/VX/16 ᆫ다/EF/17 ./SF/18")]),
]


@case(
    "SELECT * FROM (VALUES ('a', '금융위원회', '감독', '은행', false), ('b', '임원', '차입 금지', '자금', true), ('c', '법원', '해산', '은행', false), ('d', '회사', '받음', '주주의동의', false)) AS t(chunk_id, subject, predicate, object, inferred_subject)"
)
def korean_svo(spark: S, d: str) -> DataFrame:
    """REL-1 to REL-4: expected triples of a case table (a statement, a list under a prohibition, a passive, a genitive)."""
    rows = [(c, [(t, [(f, g, int(s), len(f)) for f, g, s in (x.split("/") for x in toks.split())]) for t, toks in sents]) for c, sents in _SVO]
    chunks = spark.createDataFrame(rows, f"chunk_id string, sentences array<struct<text:string,tokens:{vocab.TOKENS}>>")
    return relations.korean_triples(chunks).drop("ord")


_DEP = [
    ("a", [(0, 1, "Samsung", "Samsung", "PROPN", "nsubj", "ORG"), (1, 1, "acquired", "acquire", "VERB", "ROOT", ""), (2, 3, "Harman", "Harman", "PROPN", "compound", "ORG"), (3, 1, "International", "International", "PROPN", "dobj", "ORG"), (4, 1, "in", "in", "ADP", "prep", ""), (5, 4, "2017", "2017", "NUM", "pobj", "DATE")]),
    ("b", [(0, 2, "Hamlet", "Hamlet", "PROPN", "nsubjpass", ""), (1, 2, "was", "be", "AUX", "auxpass", ""), (2, 2, "written", "write", "VERB", "ROOT", ""), (3, 2, "by", "by", "ADP", "agent", ""), (4, 3, "Shakespeare", "Shakespeare", "PROPN", "pobj", "PERSON")]),
    ("c", [(0, 1, "She", "she", "PRON", "nsubj", ""), (1, 1, "saw", "see", "VERB", "ROOT", ""), (2, 1, "Rome", "Rome", "PROPN", "dobj", "GPE")]),
]


@case("SELECT * FROM (VALUES ('a', 'Samsung', 'acquire', 'Harman International'), ('b', 'Shakespeare', 'write', 'Hamlet')) AS t(chunk_id, subject, predicate, object)")
def english_svo(spark: S, d: str) -> DataFrame:
    """REL-5: active, passive; no date, no pronoun."""
    parsed = spark.createDataFrame(_DEP, "chunk_id string, nodes array<struct<i:int,head:int,text:string,lemma:string,pos:string,dep:string,ent_type:string>>")
    return relations.english_triples(parsed).drop("ord")


_SENTS = values("chunk_id, sent, sentence", "('a', 0, '삼성전자 이재용 회장은 서울에 갔다'), ('a', 1, '이재용 회장과 부산'), ('b', 0, '서울과 부산')")
_ENTS = values("chunk_id, ord, entity, class", "('a', 0, '삼성전자', '기관'), ('a', 1, '이재용', '인물'), ('a', 2, '서울', '지역'), ('a', 3, '부산', '지역'), ('a', 4, '이재용', '기관'), ('b', 0, '서울', '지역'), ('b', 1, '부산', '지역')")


@query(f"""WITH s AS ({_SENTS}), e AS ({_ENTS}), o AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY chunk_id, entity ORDER BY ord) = 1), i AS (SELECT s.*, ord, entity, class FROM s JOIN o USING (chunk_id) WHERE contains(sentence, entity)),
p AS (SELECT x.chunk_id, x.sent, x.entity AS s, y.entity AS o, row_number() OVER (PARTITION BY x.chunk_id ORDER BY x.sent, x.ord, y.ord) AS nth FROM i x JOIN i y ON x.chunk_id = y.chunk_id AND x.sent = y.sent AND x.ord <> y.ord WHERE x.class IN ('인물', '기관'))
SELECT chunk_id, sent, s, o, CAST(nth AS INT) AS nth FROM p WHERE nth <= 5""")
def relation_pairs(spark: S, d: str) -> DataFrame:
    """REL-7, with at most five pairs a chunk."""
    return relations.candidate_pairs(spark.sql(_SENTS), spark.sql(_ENTS), 5).select("chunk_id", "sent", "s", "o", "nth")


_REPLIES = values("id, raw", "(0, 'Sure: {\"triples\":[{\"s\":\"A\",\"p\":\"is\",\"o\":\"B\"},{\"s\":\"\",\"p\":\"x\",\"o\":\"y\"}]} done'), (1, 'no json'), (2, '{\"triples\": [{\"s\":\"A\",\"p\":\"is\"}]}'), (3, '{broken'), (4, '{\"other\": 1}')")


@query(f"""WITH t AS ({_REPLIES}), j AS (SELECT id, TRY_CAST(regexp_extract(raw, '(?s)\\{{.*\\}}') AS JSON) AS j FROM t), x AS (SELECT id, unnest(from_json(j -> '$.triples', '[{{"s":"VARCHAR","p":"VARCHAR","o":"VARCHAR"}}]')) AS x FROM j WHERE j IS NOT NULL)
SELECT id, x.s AS s, x.p AS p, x.o AS o FROM x WHERE x.s <> '' AND x.p <> '' AND x.o <> ''""")
def reply_parse(spark: S, d: str) -> DataFrame:
    """HYB-5."""
    return spark.sql(_REPLIES).select("id", F.explode(relations.parsed_reply("raw")).alias("t")).select("id", "t.s", "t.p", "t.o")


_SYN = "('국가', '나라1 국가1'), ('나라', '나라1'), ('조국', '국가1'), ('성우', '별1'), ('유성우', '별1'), ('이커머스', 'e1'), ('전자상거래', 'e1'), ('단체', 'd1'), ('모임', 'd1')"
_COUNTS = values("label, inst, ord", "('국가', 10, 0), ('나라', 5, 1), ('성우', 3, 2), ('유성우', 4, 3), ('이커머스', 2, 4), ('전자 상거래', 7, 5), ('단체', 6000, 6), ('모임', 1, 7)")
_DICT = values("surface, reps", _SYN)


def _dictionary(spark: S) -> DataFrame:
    return spark.sql(_DICT).withColumn("reps", F.split("reps", " "))


@query(f"""WITH l AS ({_COUNTS}), dict AS (SELECT surface, string_split(reps, ' ') AS reps FROM ({_DICT})), k AS (SELECT replace(label, ' ', '') AS surface, label, inst, reps FROM l JOIN dict ON surface = replace(label, ' ', '')),
p AS (SELECT x.*, y.surface AS sb, y.label AS lb, y.inst AS ib, y.reps AS rb FROM k x JOIN k y ON x.surface < y.surface AND list_has_any(x.reps, y.reps))
SELECT label AS a, lb AS b, inst AS inst_a, ib AS inst_b, array_to_string(list_filter([CASE WHEN contains(surface, sb) OR contains(sb, surface) THEN 'substr' END, CASE WHEN len(reps) > 1 OR len(rb) > 1 THEN 'ambig' END, CASE WHEN greatest(inst, ib) > 5000 THEN 'hub' END, CASE WHEN inst = 0 AND ib = 0 THEN 'zero' END], lambda x: x IS NOT NULL), ' ') AS deny FROM p""")
def class_synonyms(spark: S, d: str) -> DataFrame:
    """DED-6, DED-9."""
    return dedup.class_synonym_candidates(spark.sql(_COUNTS), _dictionary(spark)).withColumn("deny", F.array_join("deny", " "))


@case("SELECT * FROM (VALUES ('전자 상거래', '이커머스'), ('유성우', '성우'), ('모임', '단체')) AS t(old, canonical)")
def synonym_renames(spark: S, d: str) -> DataFrame:
    """DED-8: identical sets of representatives."""
    return dedup.rename_by_synonym(spark.sql(_COUNTS).withColumnRenamed("label", "name"), _dictionary(spark))


_ASK = values("a, b", "('국가', '나라'), ('국가', '조국'), ('나라', '조국'), ('나라', '없음')")


@query(f"WITH q AS ({_ASK}), dict AS (SELECT surface, string_split(reps, ' ') AS reps FROM ({_DICT})) SELECT a, b, coalesce(list_has_any(x.reps, y.reps), false) AS synonyms FROM q LEFT JOIN dict x ON x.surface = a LEFT JOIN dict y ON y.surface = b")
def synonym_pairs(spark: S, d: str) -> DataFrame:
    """DED-7."""
    return dedup.are_synonyms(spark.sql(_ASK), _dictionary(spark))


@case("SELECT * FROM (VALUES ('나라', 1), ('국가', 1), ('땅', 1), ('배', 2), ('선박', 1), ('과일', 1)) AS t(surface, n)")
def synonym_components(spark: S, d: str) -> DataFrame:
    """DED-10: sets by sense; a surface of two senses is in two sets."""
    e = spark.createDataFrame([("나라#1", "국가#1"), ("국가#1", "땅#1"), ("배#1", "선박#1"), ("배#2", "과일#1")], "a string, b string")
    return dedup.synonym_sets(e).select("surface", F.size("reps").alias("n"))


_PAIRS = values("child, parent", "('서울고등학교', '학교'), ('서울고등학교', '고등학교'), ('서울고등학교', '고등학교'), ('부산고등학교', '고등학교'), ('강아지', '동물'), ('이탈리아어', '고등학교')")
_TYPED = values("doc_id, ord, entity, class", "('a', 0, '서울고등학교', '기관'), ('a', 1, '부산 고등학교', '기관'), ('b', 0, '이탈리아어', '용어'), ('b', 1, '서울고등학교', '지역'), ('c', 0, '서울고등학교', '기관')")


@case("SELECT * FROM (VALUES ('entity', 'a', '서울고등학교', '고등학교'), ('entity', 'a', '부산 고등학교', '고등학교'), ('entity', 'b', '이탈리아어', '용어'), ('entity', 'b', '서울고등학교', '지역'), ('entity', 'c', '서울고등학교', '고등학교'), ('edge', NULL, '고등학교', '기관'), ('left', NULL, '강아지', '동물')) AS t(kind, doc_id, x, y)")
def definitional_types(spark: S, d: str) -> DataFrame:
    """TYP-1, TYP-3: pairs about entities type them, the rest stay class pairs."""
    left, typed, edges = typing.definitional_types(spark.sql(_PAIRS), spark.sql(_TYPED))
    none = F.lit(None).cast("string").alias("doc_id")
    row = lambda df, kind, doc, x, y: df.select(F.lit(kind).alias("kind"), doc, F.col(x).alias("x"), F.col(y).alias("y"))
    return row(typed, "entity", F.col("doc_id"), "entity", "class").unionByName(row(edges, "edge", none, "child", "parent")).unionByName(row(left, "left", none, "child", "parent"))


_PEOPLE = values("doc_id, ord, entity, class", "('a', 0, '수지', '인물'), ('a', 1, '갈릴레오갈릴레이', '인물'), ('b', 0, '비', '인물'), ('b', 1, '서울', '지역'), ('c', 0, '갈릴레오갈릴레이', '인물')")
_LEX = values("label, concept, conf", "('수지', '가수', 0.9), ('갈릴레오 갈릴레이', '물리학자', 0.9), ('갈릴레오 갈릴레이', '수학자', 0.8), ('비', '가수', 0.9), ('서울', '가수', 0.9)")
_NEWS = values("chunk_text", "('가수 수지가 신곡을 냈다'), ('비가 온다. 그러나 그 뒤에 아주 길게 떨어진 다음에 노래가 나온다'), ('갈릴레오 갈릴레이')")


@case("SELECT * FROM (VALUES ('a', '수지', '가수'), ('a', '갈릴레오갈릴레이', '물리학자'), ('a', '갈릴레오갈릴레이', '수학자'), ('b', '비', '인물'), ('b', '서울', '지역'), ('c', '갈릴레오갈릴레이', '물리학자')) AS t(doc_id, entity, class)")
def occupation_types(spark: S, d: str) -> DataFrame:
    """TYP-5 to TYP-7: a short name needs a cue nearby; a second occupation is a record more, once."""
    typed, _ = typing.occupation_types(spark.sql(_PEOPLE), spark.sql(_LEX).withColumn("conf", F.col("conf").cast("double")), spark.sql(_NEWS))
    return typed.select("doc_id", "entity", "class")


_LAW = values("doc_id, law, article_no, text, seq", "('d1', 'A', '제1조', '제2조에 따라 제1조를 적용하고 「상법」 제3조와 같은 법 제2조의2', 0), ('d2', 'A', '제2조', '본문 제', 1), ('d2', 'A', '', '3조 참조', 2), ('d3', 'A', '제3조', NULL, 3), ('d4', 'B', '제1조', '제2조', 4)")


@case("SELECT * FROM (VALUES ('d1', 'd2'), ('d2', 'd3')) AS t(src, dst)")
def law_citations(spark: S, d: str) -> DataFrame:
    """CIT-1 to CIT-4: scopes, masked spans, a reference split across two chunks."""
    return citations.citation_pairs(spark.sql(_LAW)).select("src", "dst")


_RAWNAMES = values("id, raw", "(0, 'class:은행(bank)'), (1, 'a<b>c'), (2, ' A B '), (3, '[x], {y}'), (4, '***'), (5, NULL), (6, 'type class')")


@query(f"""WITH t AS ({_RAWNAMES}), n AS (SELECT id, coalesce(trim(regexp_replace(regexp_replace(CASE WHEN contains(raw, ':') THEN regexp_replace(raw, '(?:class|domain|range|type):', '', 'g') ELSE raw END, '<[^>]*>', '', 'g'), '[\\[\\](){{}}<>:/,"''\\\\]', '', 'g')), '') AS name FROM t)
SELECT id, name, coalesce(nullif(regexp_replace(name, '[^0-9A-Za-z가-힣]', '', 'g'), ''), 'Unknown') AS local, CASE WHEN regexp_matches(name, '[가-힣]') THEN 'ko' ELSE 'en' END AS lang FROM n""")
def owl_names(spark: S, d: str) -> DataFrame:
    """OWL-1, OWL-2."""
    return spark.sql(_RAWNAMES).select("id", T.clean_name("raw").alias("name")).select("id", "name", T.local_name("name").alias("local"), T.label_lang("name").alias("lang"))


_PROPS = values("name, domain, range", "('감독', '은행', '회사'), ('연다', '없음', '은행'), ('', '은행', '은행')")
_DATA = values("name, domain, range", "('수', '은행', 'xsd:integer'), ('이름', '회사', 'text'), ('날', '', 'xsd:date')")


@case("""SELECT * FROM (VALUES ('감독', 'type', 'ObjectProperty'), ('연다', 'type', 'ObjectProperty'), ('감독', 'label', '감독'), ('연다', 'label', '연다'), ('감독', 'domain', '은행'), ('감독', 'range', '회사'), ('연다', 'range', '은행'),
('수', 'type', 'DatatypeProperty'), ('이름', 'type', 'DatatypeProperty'), ('날', 'type', 'DatatypeProperty'), ('수', 'label', '수'), ('이름', 'label', '이름'), ('날', 'label', '날'), ('수', 'domain', '은행'), ('이름', 'domain', '회사'), ('수', 'range', 'integer'), ('이름', 'range', 'string'), ('날', 'range', 'date')) AS t(s, p, o)""")
def owl_properties(spark: S, d: str) -> DataFrame:
    """OWL-6, OWL-7."""
    known = rdf.known_classes(spark.sql(values("name", "('은행'), ('회사')")))
    end = lambda c: F.regexp_extract(c, "[^#/]*\\z", 0).alias(c)
    out = rdf.property_triples(spark.sql(_PROPS), known, False).unionByName(rdf.property_triples(spark.sql(_DATA), known, True))
    return out.select(end("s"), end("p"), end("o"))


_HYGIENE = values("label, tokens", "('이소라 이소', NULL), ('서울', '서울/NNP'), ('는 신화다', '는/JX 신화/NNG 다/EF'), ('프랑스와', '프랑스/NNP 와/JC'), ('가', NULL), ('빨리', '빨리/MAG'), ('정치 경제', '정치/NNG 경제/NNG')")


@case("SELECT * FROM (VALUES ('이소라 이소', false), ('서울', true), ('는 신화다', false), ('프랑스와', false), ('가', false), ('빨리', false), ('정치 경제', true)) AS t(label, ok)")
def label_hygiene(spark: S, d: str) -> DataFrame:
    """NER-10."""
    return spark.sql(_HYGIENE).select("label", entities.label_ok("label", tokens()).alias("ok"))


_CUT = values("id, chunk_text, tokens, entity, s, e", "(0, '찰스턴에서', '찰스턴/NNP 에서/JKB', '찰스', 0, 2), (1, '서울역에', '서울/NNP 역/NNG 에/JKB', '서울', 0, 2), (2, '진양호', '진양호/NNP', '양', 1, 2)")


@case("SELECT * FROM (VALUES (0, '찰스턴', 3), (1, '서울', 2), (2, '양호', 3)) AS t(id, entity, stop)")
def aligned_spans(spark: S, d: str) -> DataFrame:
    """NER-7."""
    rows = spark.sql(_CUT).withColumn("tokens", tokens()).withColumnsRenamed({"s": "start", "e": "end"})
    return entities.aligned(rows).select("id", "entity", F.col("end").alias("stop"))
