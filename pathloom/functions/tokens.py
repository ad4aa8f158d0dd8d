"""Column functions on symbolic tokens: canonical forms, categories, names and colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# They must equal those of the corpus format for right results.
CATEGORY_EXACT = {
    "VEX_REG_READ": "REG",
    "VEX_REG_WRITE": "REG",
    "VEX_LOAD": "MEM",
    "VEX_STORE": "MEM",
    "VEX_EXIT_COND": "CTRL",
    "VEX_WrTmp": "TEMP",
    "VEX_CONST": "TEMP",
    "JK_BORING": "FLOW",
    "JK_CALL": "FLOW",
    "JK_RET": "FLOW",
    "JK_NODECODE": "FLOW",
    "JK_SIGTRAP": "FLOW",
    "<PAD>": "SPECIAL",
    "<UNK>": "SPECIAL",
    "<MASK>": "SPECIAL",
    "<BOS>": "SPECIAL",
    "<EOS>": "SPECIAL",
    "<UNLIFTABLE>": "SPECIAL",
    "<API_UNRESOLVABLECALLTARGET>": "API",
    "<API_UNRESOLVABLEJUMPTARGET>": "API",
}
CATEGORY_PREFIXES = (
    ("VEX_REG_", "REG"),
    ("VEX_OP_", "ARITH"),
    ("VEX_LOAD", "MEM"),
    ("VEX_STORE", "MEM"),
    ("VEX_EXIT", "CTRL"),
    ("JK_", "FLOW"),
    ("<API_", "API"),
    ("<SYSCALL_", "SYSCALL"),
    ("VEX_Ist_", "SPECIAL"),
    ("VEX_", "TEMP"),
    ("<", "SPECIAL"),
)
SHORT_NAMES = {
    "VEX_REG_READ": "REG_R",
    "VEX_REG_WRITE": "REG_W",
    "VEX_LOAD": "LOAD",
    "VEX_STORE": "STOR",
    "VEX_EXIT_COND": "EXIT",
    "VEX_WrTmp": "TMP",
    "VEX_CONST": "CST",
    "JK_BORING": "BORE",
    "JK_CALL": "CALL",
    "JK_RET": "RET",
    "JK_NODECODE": "NDEC",
    "JK_SIGTRAP": "TRAP",
    "<PAD>": "PAD",
    "<UNK>": "UNK",
    "<MASK>": "MASK",
    "<BOS>": "BOS",
    "<EOS>": "EOS",
    "<UNLIFTABLE>": "UNLT",
    "<API_UNRESOLVABLECALLTARGET>": "UNRC",
    "<API_UNRESOLVABLEJUMPTARGET>": "UNRJ",
}
TOKEN_COLORS = {
    "VEX_REG_READ": "#79c0ff",
    "VEX_REG_WRITE": "#1f6feb",
    "VEX_LOAD": "#56d4f5",
    "VEX_STORE": "#0d7a8a",
    "VEX_EXIT_COND": "#ffa657",
    "JK_BORING": "#6a5c00",
    "JK_CALL": "#388bfd",
    "JK_RET": "#da3633",
    "JK_NODECODE": "#3d444d",
    "JK_SIGTRAP": "#cf222e",
    "VEX_WrTmp": "#6e7681",
    "VEX_CONST": "#b1bac4",
    "<PAD>": "#161b22",
    "<UNK>": "#6e7681",
    "<MASK>": "#6e7681",
    "<UNLIFTABLE>": "#3d444d",
    "<API_UNRESOLVABLECALLTARGET>": "#9e4da0",
    "<API_UNRESOLVABLEJUMPTARGET>": "#7a3580",
}
BASE_HUES = {"REG": 0.595, "ARITH": 0.330, "MEM": 0.510, "CTRL": 0.075, "FLOW": 0.150, "TEMP": 0.570, "API": 0.750, "SYSCALL": 0.020, "SPECIAL": 0.000}
EDGE_COLORS = {"JK_BORING": "#8b949e", "JK_CALL": "#58a6ff", "JK_RET": "#f78166", "JK_NODECODE": "#30363d", "JK_SIGTRAP": "#e3b341"}
EDGE_DEFAULT = "#30363d"
STRUCTURAL = (
    "VEX_WrTmp", "VEX_OP_64T", "VEX_OP_32U", "VEX_OP_16U", "VEX_OP_8UT", "VEX_OP_1UT", "VEX_OP_32S", "VEX_OP_16S",
    "VEX_OP_8ST", "VEX_OP_1ST", "VEX_OP_F64", "VEX_OP_F32", "VEX_OP_I64", "VEX_OP_I32", "VEX_Ist_AbiHint",
)
JUMPS = ("JK_BORING", "JK_CALL", "JK_RET", "JK_NODECODE", "JK_SIGTRAP")


def _lookup(key: Column, values: dict[str, str], default: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    return F.coalesce(F.try_element_at(table, key), default)


def categorize(token: Column) -> Column:
    """The category of a token: exact names, then the first prefix that fits, else SPECIAL."""
    by_prefix = F.lit("SPECIAL")
    for prefix, name in reversed(CATEGORY_PREFIXES):
        by_prefix = F.when(token.startswith(prefix), name).otherwise(by_prefix)
    return _lookup(token, CATEGORY_EXACT, by_prefix)


def display_name(token: Column) -> Column:
    """A short name: of known tokens fixed, of the families six characters, else seven of the token."""
    inner = F.coalesce(*(F.nullif(F.regexp_extract(token, p, 1), F.lit("")) for p in (r"^VEX_OP_(.+)$", r"^<API_(.+)>$", r"^<SYSCALL_(.+)>$", r"^JK_(.+)$", r"^VEX_Ist_(.+)$")))
    return _lookup(token, SHORT_NAMES, F.coalesce(F.substring(inner, 1, 6), F.substring(token, 1, 7)))


def edge_color(jump: Column) -> Column:
    return _lookup(jump, EDGE_COLORS, F.lit(EDGE_DEFAULT))


def token_color(token: Column) -> Column:
    """The fixed colour of a token, or one in the hue of its category, varied by its MD5 hash.

    The arithmetic is fixed: it must give the same colours wherever the tokens are drawn.
    """
    category = categorize(token)
    h = F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long")
    base = F.try_element_at(F.create_map(*(F.lit(x) for kv in BASE_HUES.items() for x in kv)), category)
    hue = F.pmod(base + (F.shiftright(h, 16) % 9 - 4) * F.lit(0.01), F.lit(1.0))
    light = F.when(category == "SPECIAL", F.lit(0.13) + (h % 4) * F.lit(0.04)).when(category == "TEMP", F.lit(0.38) + (h % 6) * F.lit(0.05)).otherwise(F.lit(0.42) + (F.shiftright(h, 8) % 6) * F.lit(0.05))
    sat = F.when(category == "SPECIAL", F.lit(0.10)).when(category == "TEMP", F.lit(0.28) + (h % 5) * F.lit(0.08)).otherwise(F.lit(0.60) + (h % 7) * F.lit(0.05))
    high = F.when(light <= 0.5, light * (sat + 1.0)).otherwise(light + sat - light * sat)
    low = light * 2.0 - high

    def channel(turn: float) -> Column:
        x = F.pmod(hue + F.lit(turn), F.lit(1.0))
        v = F.when(x < F.lit(1 / 6), low + (high - low) * x * 6.0).when(x < 0.5, high).when(x < F.lit(2 / 3), low + (high - low) * (F.lit(2 / 3) - x) * 6.0).otherwise(low)
        return F.lower(F.lpad(F.hex((v * 255).cast("int")), 2, "0"))

    return _lookup(token, TOKEN_COLORS, F.concat(F.lit("#"), channel(1 / 3), channel(0.0), channel(-1 / 3)))


def canon_op(tag: Column, op: Column) -> Column:
    """The token of a temporary's data: its operation's first three letters after the ``_``, or that of its kind."""
    part = F.try_element_at(F.split(op, "_"), F.lit(2))
    kinds = {"Iex_Load": "VEX_LOAD", "Iex_Const": "VEX_CONST", "Iex_Get": "VEX_REG_READ"}
    named = F.concat(F.lit("VEX_OP_"), F.upper(F.substring(part, 1, 3)))
    return F.when(op.contains("_"), named).when(tag.isNull(), "VEX_WrTmp").otherwise(_lookup(tag, kinds, F.lit("VEX_WrTmp")))


def canon_stmt(tag: Column, data_tag: Column, op: Column) -> Column:
    """The token of a statement; null for those that have none."""
    kinds = {"Ist_Store": "VEX_STORE", "Ist_Put": "VEX_REG_WRITE", "Ist_Exit": "VEX_EXIT_COND"}
    other = _lookup(tag, kinds, F.concat(F.lit("VEX_"), tag))
    return F.when(tag.isNull() | (tag == "Ist_IMark"), F.lit(None).cast("string")).when(tag == "Ist_WrTmp", canon_op(data_tag, op)).otherwise(other)


def canon_block(statements: Column, lifted: Column) -> Column:
    """The tokens of a block's statements (tag, data_tag, op), in order; one token of its own where lifting failed."""
    tokens = F.transform(statements, lambda s: canon_stmt(s["tag"], s["data_tag"], s["op"]))
    return F.when(lifted, F.filter(tokens, lambda t: t.isNotNull())).otherwise(F.array(F.lit("<UNLIFTABLE>")))


def canon_api(name: Column, kind: Column) -> Column:
    """``<API_NAME>`` of a library function, ``<SYSCALL_NAME>`` of a system call, else null."""
    api = F.concat(F.lit("<API_"), F.upper(F.substring_index(name, "@", 1)), F.lit(">"))
    call = F.concat(F.lit("<SYSCALL_"), F.upper(name), F.lit(">"))
    return F.when(kind.isin("plt", "simprocedure"), api).when(kind == "syscall", call)


def canon_jump(jumpkind: Column, api: Column) -> Column:
    """The last token of a block: that of the function it goes to, or of its kind of jump."""
    return F.coalesce(api, F.concat(F.lit("JK_"), F.upper(F.replace(F.coalesce(jumpkind, F.lit("Ijk_Unknown")), F.lit("Ijk_"), F.lit("")))))


def addr_hex(number: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(number)))


def addr_number(text: Column) -> Column:
    """A hexadecimal address as a number, with or without ``0x``, in any case."""
    return F.conv(F.regexp_replace(F.lower(F.btrim(text)), "^0x", ""), 16, 10).cast("long")


def parse_label(name: Column) -> Column:
    """struct(util, compiler, opt) of ``<util>_<gcc|clang>_<O?>`` with one of the known endings; null otherwise."""
    pattern = r"^(.+)_(gcc|clang)_(O[0-9s])(?:\.elf)?(?:-embeddings\.json)?$"
    parts = [F.regexp_extract(name, pattern, i) for i in (1, 2, 3)]
    return F.when(parts[0] != "", F.struct(parts[0].alias("util"), parts[1].alias("compiler"), parts[2].alias("opt")))


def make_label(path: Column) -> Column:
    """The file name without directories and the known endings."""
    return F.regexp_replace(F.substring_index(F.btrim(path), "/", -1), r"(-embeddings)?\.(jsonl|json|elf)$", "")
