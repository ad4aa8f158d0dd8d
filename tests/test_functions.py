"""Golden cases of the column functions."""

import hashlib

import pytest
from pyspark.sql import functions as F

from pathloom.functions import arrays as A
from pathloom.functions import tokens as K
from pathloom.functions import vectors as V


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def of(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").orderBy("i")
    return [r[0] for r in df.select(f(F.col("t"))).collect()]


def test_categories(spark):
    tokens = ["VEX_OP_64T", "VEX_Ist_Dirty", "VEX_FOO", "<SYSCALL_READ>", "foo", "VEX_REG_READ", "<API_X>", "JK_PRIVILEGED", "VEX_STORE_G", "<X>", "VEX_EXIT_2", None]
    assert of(spark, tokens, K.categorize) == ["ARITH", "SPECIAL", "TEMP", "SYSCALL", "SPECIAL", "REG", "API", "FLOW", "MEM", "SPECIAL", "CTRL", "SPECIAL"]


def test_display_names(spark):
    tokens = ["JK_PRIVILEGED", "<API_MALLOC>", "VEX_OP_64T", "VEX_STORE", "something_long", "<SYSCALL_WRITEV2>", "VEX_Ist_AbiHint", "<UNK>"]
    assert of(spark, tokens, K.display_name) == ["PRIVIL", "MALLOC", "64T", "STOR", "somethi", "WRITEV", "AbiHin", "UNK"]


def test_canonical_operations(spark):
    def op(tag, op):
        return one(spark, x=K.canon_op(F.lit(tag).cast("string"), F.lit(op).cast("string"))).x

    assert op("Iex_Binop", "Iop_Sub32") == "VEX_OP_SUB"
    assert op("Iex_Unop", "Iop_64to1") == "VEX_OP_64T"
    assert op("Iex_Binop", "Iop_Or64") == "VEX_OP_OR6"
    assert [op(t, None) for t in ("Iex_Load", "Iex_Const", "Iex_Get", "Iex_Binop", None)] == ["VEX_LOAD", "VEX_CONST", "VEX_REG_READ", "VEX_WrTmp", "VEX_WrTmp"]


def test_canonical_statements_and_jumps(spark):
    s = lambda *v: one(spark, x=K.canon_stmt(*(F.lit(x).cast("string") for x in v))).x
    assert s("Ist_IMark", None, None) is None and s(None, None, None) is None
    assert s("Ist_WrTmp", "Iex_Binop", "Iop_Add8") == "VEX_OP_ADD" and s("Ist_Put", None, None) == "VEX_REG_WRITE" and s("Ist_CAS", None, None) == "VEX_Ist_CAS"
    j = lambda *v: one(spark, x=K.canon_jump(*(F.lit(x).cast("string") for x in v))).x
    assert j("Ijk_Boring", None) == "JK_BORING" and j("Ijk_Call", "<API_X>") == "<API_X>" and j(None, None) == "JK_UNKNOWN"
    a = lambda *v: one(spark, x=K.canon_api(*(F.lit(x).cast("string") for x in v))).x
    assert a("printf@GLIBC", "plt") == "<API_PRINTF>" and a("read", "syscall") == "<SYSCALL_READ>" and a("f", "plain") is None


def test_colours(spark):
    import colorsys

    assert of(spark, ["JK_RET", "<PAD>"], K.token_color) == ["#da3633", "#161b22"]
    token = "VEX_OP_ADD"
    h = int(hashlib.md5(token.encode()).hexdigest()[:8], 16)
    rgb = colorsys.hls_to_rgb((0.330 + ((h >> 16) % 9 - 4) * 0.01) % 1.0, 0.42 + ((h >> 8) % 6) * 0.05, 0.60 + (h % 7) * 0.05)
    got = of(spark, [token], K.token_color)[0]
    assert all(abs(int(got[i : i + 2], 16) - int(c * 255)) <= 1 for i, c in zip((1, 3, 5), rgb, strict=True))
    assert of(spark, ["JK_CALL", "x", None], K.edge_color) == ["#58a6ff", "#30363d", "#30363d"]


def test_labels_and_addresses(spark):
    r = of(spark, ["a_b_gcc_O2.elf-embeddings.json", "x_clang_Os", "x_icc_O2", "?", None], K.parse_label)
    assert [tuple(x) if x else None for x in r] == [("a_b", "gcc", "O2"), ("x", "clang", "Os"), None, None, None]
    assert of(spark, ["/a/b/ls_gcc_O2.elf", " x.jsonl", "y-embeddings.json"], K.make_label) == ["ls_gcc_O2", "x", "y"]
    assert of(spark, ["0x1F", "0X1f", "1f", "  0x001f"], K.addr_number) == [31] * 4
    assert one(spark, x=K.addr_hex(F.lit(255))).x == "0xff"


def bits(spark, f, ids):
    i, p = f(F.array(*map(F.lit, ids)))
    r = one(spark, i=i, p=p)
    return [k for k, x in enumerate(r.i) if x], [k for k, x in enumerate(r.p) if x]


def test_masks(spark):
    ids = [5, 6, 7, 8, 9, 10, 11, 0, 0]
    assert bits(spark, A.thirds_mask, ids) == ([2, 3, 4, 5, 6], [4, 5, 6])
    assert bits(spark, A.last_token_mask, ids) == ([4, 5, 6], [6])
    for f in (A.thirds_mask, A.last_token_mask):
        assert bits(spark, f, [0, 0, 0]) == ([], [])
    assert bits(spark, lambda x: A.random_token_mask(x, F.lit(1)), [0, 0]) == ([], [])
    for seed in range(8):
        i, p = bits(spark, lambda x, s=seed: A.random_token_mask(x, F.lit(3), s), ids)
        assert i == p and len(i) == 1 and i[0] < 7
        i, p = bits(spark, lambda x, s=seed: A.random_block_mask(x, F.lit(3), 4, s), ids)
        assert i == p and len(i) == 4 and i == list(range(i[0], i[0] + 4))


def test_padding(spark):
    x = F.array(*map(F.lit, [7, 8, 9]))
    r = one(spark, a=A.pad_truncate(x, 5), b=A.pad_truncate(x, 2), c=A.bos_eos(x, 3, 4, 4), u=A.unlikeness(x, F.array(F.lit(7), F.lit(1))), o=A.overflow(x.cast("array<string>"), 2))
    assert r.a == [7, 8, 9, 0, 0] and r.b == [7, 8] and r.c == [3, 7, 8, 4] and r.u == pytest.approx(2 / 3) and r.o == ["7", "…+2"]


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(3.0))
    r = one(spark, n=V.norm(a), d=V.distance(a, b), p=V.dot(a, b), c=V.cosine(a, b), z=V.l2_normalize(F.array(F.lit(0.0))), u=V.l2_normalize(a), m=V.chunk_mean(F.array(*map(F.lit, [1.0, 2.0, 3.0, 4.0, 9.0])), 2), s=V.chunk_mean(b, 2))
    assert (r.n, r.d, r.p) == (5.0, 4.0, 9.0) and r.c == pytest.approx(0.6) and r.z == [0.0] and r.u == pytest.approx([0.6, 0.8])
    assert r.m == [2.0, 3.0] and r.s == [3.0, 0.0]


def test_tables_of_tokens_hold_the_expected_values(spark):
    # written out, not taken from the tables under test
    want = {
        "VEX_REG_READ": ("REG", "REG_R"), "VEX_REG_FOO": ("REG", "VEX_REG"), "VEX_LOAD": ("MEM", "LOAD"), "VEX_STORE": ("MEM", "STOR"), "VEX_EXIT_COND": ("CTRL", "EXIT"),
        "VEX_WrTmp": ("TEMP", "TMP"), "VEX_CONST": ("TEMP", "CST"), "VEX_OP_64T": ("ARITH", "64T"), "VEX_Ist_Dirty": ("SPECIAL", "Dirty"), "VEX_FOO": ("TEMP", "VEX_FOO"),
        "JK_BORING": ("FLOW", "BORE"), "JK_PRIVILEGED": ("FLOW", "PRIVIL"), "<API_MALLOC>": ("API", "MALLOC"), "<SYSCALL_READ>": ("SYSCALL", "READ"), "<UNLIFTABLE>": ("SPECIAL", "UNLT"), "foo": ("SPECIAL", "foo"), "<PAD>": ("SPECIAL", "PAD"),
    }
    df = spark.createDataFrame([(t,) for t in want], "t string")
    got = {r.t: (r.c, r.n) for r in df.select("t", K.categorize(F.col("t")).alias("c"), K.display_name(F.col("t")).alias("n")).collect()}
    assert got == want
    edges = {"JK_BORING": "#8b949e", "JK_CALL": "#58a6ff", "JK_RET": "#f78166", "JK_NODECODE": "#30363d", "JK_SIGTRAP": "#e3b341", "JK_OTHER": "#30363d"}
    df = spark.createDataFrame([(t,) for t in edges], "t string")
    assert {r.t: r.c for r in df.select("t", K.edge_color(F.col("t")).alias("c")).collect()} == edges
