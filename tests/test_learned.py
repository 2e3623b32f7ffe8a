"""Queries under a learned vocabulary: at 8,000 ids SQL would need a CTE for each of 7,739 merges,
so the same queries run here with a small vocabulary next to that SQL, and the learner and
the encoder next to sequential ones (test_bpe)."""
import pytest

from tests.oracle_compare import duck, rows_of
from wordloom.plans import catalog, oracle as O, params as P

SF = "/root/testdata/sf0.001"
VOCAB = 300


def learned() -> list[str]:
    """``m0..`` with the best pair of every step, ``merges`` and the last state; symbols are
    characters (id + 256)."""
    out = [O.CORPUS, O.PIECE_COUNTS, f"""st0 as materialized (select array_to_string(list_transform({O.byte_ids_sql('piece')},
  lambda x: chr((x + 256)::int)), '') as s, n from pc)"""]
    for k in range(VOCAB - 261):
        new = 261 + k
        out.append(f"""m{k} as materialized (select {k} as rank, unicode(l) - 256 as left_id, unicode(r) - 256 as right_id,
  {new} as new_id, l || r as pair from (
  select substr(s, i::int, 1) as l, substr(s, i::int + 1, 1) as r, sum(n) as c
  from (select s, n, unnest(range(1, length(s))) as i from st{k}) group by all) where c >= 2
  order by c desc, greatest(unicode(l), unicode(r)), unicode(l), unicode(r) limit 1)""")
        out.append(f"""st{k + 1} as materialized (select replace(s, (select pair from m{k}), chr({new + 256})) as s, n from st{k})""")
    return out + ["merges as (" + " union all ".join(f"select * from m{k}" for k in range(VOCAB - 261)) + ")"]


def ids_sql(table: str, keys: str, text: str, name: str) -> list[str]:
    """``name (keys, ids)``: learned ids of ``text`` in ``table``."""
    merged = "s0"
    for k in range(VOCAB - 261):
        merged = f"replace({merged}, (select pair from m{k}), chr({261 + k + 256}))"
    return [f"""{name}_p as (select {keys}, unnest({O.pieces_sql(text)}) as piece,
  unnest(range(0, len({O.pieces_sql(text)}))) as pos from {table})""",
            f"""{name}_d as (select piece, list_transform(regexp_extract_all(s1, '(?s).'), lambda c: unicode(c) - 256) as e from (
  select piece, {merged} as s1 from (select piece, array_to_string(list_transform({O.byte_ids_sql('piece')},
  lambda x: chr((x + 256)::int)), '') as s0 from (select distinct piece from {name}_p))))""",
            f"""{name} as (select {keys}, flatten(list(e order by pos)) as ids from {name}_p join {name}_d using (piece)
  group by all)"""]


def vocab_sql() -> str:
    out = ["v0 as (select i::int as id, case when i < 5 then '' else printf('%02X', i - 5) end as hex from range(0, 261) r(i))"]
    for k in range(VOCAB - 261):
        out.append(f"""v{k + 1} as (select id, hex from v{k} union all select new_id, a.hex || b.hex from m{k}
  join v{k} a on a.id = left_id join v{k} b on b.id = right_id)""")
    return O._w(*learned(), *out) + f"select id, hex as token_hex, id < 5 as special from v{VOCAB - 261}"


def sql() -> dict[str, str]:
    encode = """select source, doc_id, len(ids)::bigint as n_tokens,
  array_to_string(ids, ' ') as ids from learned"""
    encoded = [*learned(), *ids_sql("corpus", "source, ord, doc_id", "text", "learned")]
    merges = O._w(*learned()) + "select rank, left_id, right_id, new_id from merges"
    return {
        "b6_learn_merges": merges, "a7_tokenizer_tables": merges, "b7_vocab": vocab_sql(),
        "b8_encode_merged": O._w(*encoded) + encode, "b8_encode_dictionary": O._w(*encoded) + encode,
        "c3_head_split_merged": O._w(*encoded, "lens as (select source, ord, doc_id, len(ids)::bigint + 1 as n from learned)",
                                     O.cut_sql(P.BUDGET // 2)) + "select source, split, doc_id, pos::bigint as pos, len::bigint as len from segs",
        "e7_chat_encode_merged": O._w(*learned(), *O._CHAT, *ids_sql("chatu", "source, row_id", 'chr(10) || "user"', "eu"),
                                      *ids_sql("chatu", "source, row_id", "chr(10) || assistant", "ea")) +
        """select source, row_id, (len(eu.ids) + 2)::int as n_prompt, (len(eu.ids) + len(ea.ids) + 3)::int as n_full,
  md5(array_to_string(list_concat([3], eu.ids, [4], ea.ids, [0]), ' ')) as full_md5
from eu join ea using (source, row_id)"""}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", ["a7_tokenizer_tables", "b6_learn_merges", "b7_vocab", "b8_encode_dictionary", "b8_encode_merged",
                                  "c3_head_split_merged", "e7_chat_encode_merged"])
def test_small_vocabulary_equals_sql(spark, con, monkeypatch, name):
    monkeypatch.setattr(P, "VOCAB", VOCAB)
    got = rows_of(catalog.registry()[name](spark, SF).toPandas())
    assert got == rows_of(con.execute(sql()[name]).df())


def test_registered_vocabulary_is_whole():
    assert P.VOCAB == 8000


def test_merges_come_many_a_round(spark):
    """Every pair stands in most pieces; still a few rounds learn all merges, and the same ones as one-at-a-time greedy."""
    import random
    from tests.test_bpe import learn_merges_sequential
    from wordloom.operators.bpe import learn_merges
    rng = random.Random(11)
    words = {"".join(rng.choice("abcde") for _ in range(rng.randint(4, 9))): rng.randint(1, 50) for _ in range(6000)}
    df = spark.createDataFrame(list(words.items()), "piece string, n bigint")
    stats: dict = {}
    got = learn_merges(df, 261 + 80, stats=stats).merges
    assert got == learn_merges_sequential({k.encode(): n for k, n in words.items()}, 261 + 80).merges
    assert stats["rounds"] <= 6


def test_many_pieces_merge_at_once():
    """Lists of any length, self-pairs and long runs: as the heap merges them one by one."""
    import random
    import pyarrow as pa
    from wordloom.operators.bpe import MergeTable, encode_piece
    rng = random.Random(2)
    for _ in range(20):
        pairs = [(102, 102)]
        while len(pairs) < 25:
            p = (rng.choice([102, 103, 104, *range(261, 261 + len(pairs))]), rng.choice([102, 103, *range(261, 261 + len(pairs))]))
            pairs += [p] if p not in pairs else []
        pieces = [bytes(rng.choice(b"aabc") for _ in range(rng.choice([0, 1, 2, 7, 40, 400]))) for _ in range(40)] + [b"a" * 301]
        flat, ends = MergeTable(pairs).encode(pa.array(pieces, pa.binary()))
        ranks = {p: r for r, p in enumerate(pairs)}
        assert [flat[i:j].tolist() for i, j in zip(ends, ends[1:])] == [encode_piece(p, pairs, ranks) for p in pieces]
