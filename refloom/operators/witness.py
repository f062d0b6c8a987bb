"""Text witness: before a symbol goes, consumers' source text is searched for its name.

Files are tokenised once: import specifiers and identifiers become rows, and the search is
an equi join of tokens with the names of the symbols under review, instead of one
expression a symbol. Text that cannot be read counts as a hit (fail closed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.functions import globs
from refloom.functions.source_text import searched_text_udf
from refloom.functions.text import bare_package
from refloom.operators.addresses import addresses, specifier_forms
from refloom.operators.analysis import Analysis, anti, marked, semi
from refloom.operators.crossing import crossing_hits
from refloom.operators.quoted import quoted_hits
from refloom.storage import materialize

MAX_REASONS = 5
# How a file names another package, by manager (the specifier is group 1).
NPM_IMPORTS = (
    r"""(?s)\b(?:import|export)\b[^;]*?\bfrom\s*['"]([^'"]+)['"]""",
    r"""\bimport\s*['"]([^'"]+)['"]""",
    r"""\brequire\(\s*['"]([^'"]+)['"]""",
    r"""\bimport\(\s*['"]([^'"]+)['"]""",
)
PUB_IMPORTS = (r"""\b(?:import|export)\s+['"]package:([^'"]+)['"]""",)
# Directive lines that name a package's own declarations, by manager; files of code.
OWN_DIRECTIVES = {"npm": r"""^\s*export\b.*\bfrom\s*['"]""", "pub": r"""^\s*(?:export|part|show|hide)\b|^\s*import\s+['"].*\b(?:show|hide)\b"""}
CODE_FILE = r"\.(?:ts|tsx|js|jsx|mjs|cjs|mts|cts|dart)$"
#: Members never searched for an extension: Object's, and shorter names.
OBJECT_MEMBERS, MIN_MEMBER = ("toString", "hashCode", "noSuchMethod", "runtimeType"), 3
#: Put before a word that follows one dot or two (an access, not a spread of three).
DOTTED = "\u0001"
FILE = ["package_id", "file"]


def _extracted(text: str, patterns: tuple[str, ...]) -> Column:
    return F.explode(F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns]))))


def mentions(files: DataFrame) -> DataFrame:
    """package_id, file, manager, name, subpath: packages that a file imports; ``subpath`` is what follows the name (null: nothing)."""
    a = files.select(*FILE, _extracted("text", NPM_IMPORTS).alias("s")).withColumn("manager", F.lit("npm")).withColumn("name", bare_package(F.col("s")))
    b = files.select(*FILE, _extracted("text", PUB_IMPORTS).alias("s")).where("instr(s, '/') > 0")
    b = b.withColumn("manager", F.lit("pub")).withColumn("name", F.substring_index("s", "/", 1))
    rest = F.expr("substr(s, length(name) + 1)")
    return a.unionByName(b).select(*FILE, "manager", "name", F.when(rest != "", rest).alias("subpath")).distinct()


def identifiers(files: DataFrame) -> DataFrame:
    """package_id, file, line (from 1), token, member, directive_npm, directive_pub.

    A token is a whole identifier of the line; ``member`` if every place of it there follows
    a dot, also one of a line before. A dollar sign belongs to an identifier on its right
    side only, so what follows one is a token too.
    """
    word = "[A-Za-z0-9_$]"
    marked_ = F.regexp_replace("text", rf"(?<!\.)\.{{1,2}}\s{{0,78}}(?={word})", F.lit(f"$0{DOTTED}"))
    lines = files.select(*FILE, F.posexplode(F.split(marked_, "\r?\n")).alias("n", "l"))
    found = F.arrays_zip(*[F.regexp_extract_all("l", F.lit(f"({DOTTED}?)({word}+)"), F.lit(k)).alias(c) for k, c in ((1, "dot"), (2, "word"))])
    bare = F.regexp_replace("l", DOTTED, "")
    rows = lines.select(*FILE, (F.col("n") + 1).alias("line"), *[bare.rlike(x).alias(f"directive_{m}") for m, x in OWN_DIRECTIVES.items()], F.explode(found).alias("w"))
    rows = rows.select(*FILE, "line", "directive_npm", "directive_pub", F.col("w.word").alias("word"), (F.col("w.dot") != "").alias("dotted"))
    tails = F.expr("filter(transform(sequence(1, length(word)), i -> if(i = 1 OR substr(word, i - 1, 1) = '$', struct(substr(word, i) AS token, dotted AND i = 1 AS dotted), null)), x -> x IS NOT NULL)")
    each = F.when(F.col("word").contains("$"), tails).otherwise(F.array(F.struct(F.col("word").alias("token"), "dotted")))
    rows = rows.select(*FILE, "line", "directive_npm", "directive_pub", F.inline(each))
    return rows.groupBy(*FILE, "line", "token").agg(F.bool_and("dotted").alias("member"), F.first("directive_npm").alias("directive_npm"), F.first("directive_pub").alias("directive_pub"))


def odd_names(lines_of: DataFrame, names: DataFrame) -> DataFrame:
    """Matches of names that are no plain identifiers (operators, private marks): few, so lines are looked through."""
    odd = names.where(~F.col("token").rlike(r"^[A-Za-z0-9_$]+$"))
    lines = lines_of.select(*FILE, "target_package_id", F.posexplode(F.split("text", "\r?\n")).alias("n", "l")).join(odd, "target_package_id")
    exact = F.rlike("l", F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), "token", F.lit(r"\E(?![A-Za-z0-9_$])")))
    return lines.where((F.instr("l", F.col("token")) > 0) & exact).select(*FILE, "target_package_id", "symbol_id", "token", "member_id", (F.col("n") + 1).alias("line"))


def extension_members(a: Analysis, names: DataFrame) -> DataFrame:
    """symbol_id, target_package_id, token, member_id: public member names of extensions that are not their own names."""
    symbols = a.t["symbols"]
    children = symbols.select(F.col("parent_symbol_id").alias("symbol_id"), F.col("name").alias("token"), F.col("symbol_id").alias("member_id"))
    plain = F.col("token").rlike(r"^[A-Za-z$][A-Za-z0-9_$]*$") & (F.length("token") >= MIN_MEMBER) & ~F.col("token").isin(*OBJECT_MEMBERS)
    of = semi(names.select("symbol_id", "target_package_id").distinct(), symbols.where("kind = 'extension'"), ["symbol_id"])
    found = of.join(children.where(plain), "symbol_id").groupBy("symbol_id", "target_package_id", "token").agg(F.min("member_id").alias("member_id"))
    return anti(found, names, ["symbol_id", "token"])


def reaching_forms(a: Analysis, entries: DataFrame, manifests: DataFrame | None) -> DataFrame:
    """symbol_id, form, value of specifiers that load one of the symbol's files (``entries``: symbol_id, file; see ``addresses``)."""
    of = entries.distinct().join(a.t["symbols"].select("symbol_id", "package_id"), "symbol_id")
    return addresses(of, a.t["packages"].select("package_id", "path"), manifests)


# --- the search -----------------------------------------------------------------------------


def _reached(imports: DataFrame, forms: DataFrame, named: DataFrame) -> DataFrame:
    """File keys, target_package_id and symbol_id of imports whose specifier reaches the symbol."""
    given = specifier_forms(imports)
    of = named.select("symbol_id", "target_package_id").distinct()
    exact = given.join(forms.join(of, "symbol_id"), ["target_package_id", "form", "value"])
    anything = given.where("form = 'any'").join(of, "target_package_id")
    columns = [*FILE, "target_package_id", "symbol_id"]
    return exact.select(*columns).unionByName(anything.select(*columns)).distinct()


def witness_hits(a: Analysis, pending: DataFrame, files: DataFrame, manifests: DataFrame | None = None) -> DataFrame:
    """symbol_id, package_id (``self`` for the symbol's own package, ``self-string`` for its own literals), file, line of text that may use a symbol under review.

    ``files``: package_id, file, text (null: could not be read) of every checkout; only code
    files are searched, without comments, and in files that the index saw without strings.
    Consumers are packages that depend on the symbol's, listed extra files (witness_files),
    and the symbol's own files that the index did not see and that import their package by
    name. In test files only dev dependencies and test-support symbols count unless policy
    counts tests, documents only by policy. In npm a file vouches for a symbol only if a
    specifier reaches one of its entries (``manifests``: see ``reaching_forms``).
    """
    s = a.t["symbols"]
    target = a.t["packages"].select(F.col("package_id").alias("target_package_id"), "manager", "name")
    base = pending.select("symbol_id").join(s.select("symbol_id", F.col("package_id").alias("target_package_id"), F.col("name").alias("token"), F.col("file").alias("own_file"), "line"), "symbol_id")
    # what several steps read is written once, so that plans stay small
    base = materialize(base.join(target.select("target_package_id", "manager"), "target_package_id"))
    exported = semi(a.t["symbol_exports"], pending, "symbol_id").select("symbol_id", "entry_file", "exported_as")
    aliases = base.select("symbol_id", "target_package_id", "manager").join(exported, "symbol_id").withColumnRenamed("exported_as", "token")
    names = base.select("symbol_id", "target_package_id", "manager", "token").unionByName(aliases.drop("entry_file")).where("manager <> 'npm' or token <> 'default'").drop("manager").distinct()
    names = materialize(names.withColumn("member_id", F.lit(None).cast("long")).unionByName(extension_members(a, names)))
    deps = a.t["package_deps"].where("resolved_package_id is not null").groupBy(F.col("consumer_package_id").alias("package_id"), F.col("resolved_package_id").alias("target_package_id")).agg(F.bool_or("dev").alias("dev"))

    classed = materialize(marked(marked(files, a.test_files.unionByName(_by_name(files, globs.TEST_GLOBS, a)).distinct(), FILE, "in_test"), a.doc_files.unionByName(_by_name(files, globs.DOCS_GLOBS, a)).distinct(), FILE, "in_docs"))
    extra = a.t["witness_files"].select(F.col("consumer_package_id").alias("package_id"), "file", "target_package_id").distinct()
    unread = classed.where("text is null").join(deps, "package_id").join(names, "target_package_id").select("symbol_id", "package_id", "file", F.lit(0).alias("line"))
    lost = anti(extra, files.where("text is not null"), FILE).join(names, "target_package_id").select("symbol_id", _label().alias("package_id"), "file", F.lit(0).alias("line"))
    readable = marked(classed.where(F.col("text").isNotNull()), a.t["documents"], FILE, "indexed")
    readable = marked(readable, a.generated_files, FILE, "generated")
    listed = marked(readable, extra, FILE, "listed").where(F.col("file").rlike(CODE_FILE) | F.col("listed"))
    listed = listed.withColumn("read", searched_text_udf("text", "file", F.col("indexed"), F.col("file").rlike(CODE_FILE))).withColumns({"text": F.col("read.text"), "code": F.col("read.code"), "defaults": F.col("read.defaults")}).drop("read")
    listed = materialize(listed)

    imports = materialize(mentions(listed).join(target, ["manager", "name"]))
    used = imports.where("package_id <> target_package_id").join(deps.withColumn("own", F.lit(False)), ["package_id", "target_package_id"])
    more = imports.where("package_id <> target_package_id").join(extra, [*FILE, "target_package_id"]).join(deps, ["package_id", "target_package_id"], "left").withColumns({"own": F.lit(False), "dev": F.coalesce("dev", F.lit(False))})
    # a package's own files count as code only: an import in a string is generated text
    unseen = listed.where("not indexed and not generated").withColumn("text", F.col("code"))
    inside = mentions(unseen).join(target, ["manager", "name"]).where("package_id = target_package_id").withColumns({"own": F.lit(True), "dev": F.lit(False)})
    columns = [*FILE, "target_package_id", "manager", "subpath", "own", "dev"]
    imports = materialize(used.select(*columns).unionByName(more.select(*columns)).unionByName(inside.select(*columns)).distinct())
    forms = reaching_forms(a, aliases.where("manager = 'npm'").select("symbol_id", F.col("entry_file").alias("file")), manifests)
    vouched = _reached(imports.where("manager = 'npm'"), forms, names)
    dart = imports.where("manager = 'pub'").join(names.select("symbol_id", "target_package_id").distinct(), "target_package_id").select(*FILE, "target_package_id", "symbol_id").distinct()
    # an own listed file that loads its package's modules relatively names no package
    plain = extra.where("package_id = target_package_id").join(names.select("symbol_id", "target_package_id").distinct(), "target_package_id").select(*FILE, "target_package_id", "symbol_id")
    of_file = imports.groupBy(*FILE, "target_package_id").agg(F.bool_or("own").alias("own"), F.bool_or("dev").alias("dev"), F.first("manager").alias("manager"))
    near = vouched.unionByName(dart).distinct().join(of_file, [*FILE, "target_package_id"])
    near = near.unionByName(plain.join(target.select("target_package_id", "manager"), "target_package_id").withColumns({"own": F.lit(False), "dev": F.lit(False)}).select(near.columns)).distinct()
    near = materialize(near)

    texts = semi(listed, near, FILE)
    sought = near.join(names, ["symbol_id", "target_package_id"])
    met = sought.where("not own").join(identifiers(texts), [*FILE, "token"])
    own_code = semi(unseen, near.where("own"), FILE)
    met = met.unionByName(sought.where("own").join(identifiers(own_code), [*FILE, "token"]))
    met = met.where(~F.col("own") | ~F.when(F.col("manager") == "pub", F.col("directive_pub")).otherwise(F.col("directive_npm")))
    kept = [*near.columns, "token", "member_id", "line", "member"]
    wanted = near.where("not own").select(*FILE, "target_package_id").distinct()
    odd = odd_names(texts.join(wanted, FILE), names).withColumn("member", F.lit(False))
    met = met.select(*kept).unionByName(odd.join(near.where("not own"), [*FILE, "target_package_id", "symbol_id"]).select(*kept))

    # where the index saw the file, its own reading of the name on that line decides against text
    met = met.join(listed.select(*FILE, "indexed", "in_test", "in_docs"), FILE)
    here = a.t["occurrences"].where("line is not null").select("symbol_id", *FILE, (F.col("line") + 1).alias("line"))
    shown = here.join(s.select("symbol_id", F.col("name").alias("token")), "symbol_id").select(*FILE, "line", "token").distinct()
    met = materialize(met)
    known = met.where("indexed and (member_id is not null or not member)")
    itself = here.withColumnRenamed("symbol_id", "meant").distinct()
    meant = known.withColumn("meant", F.coalesce("member_id", "symbol_id"))
    met = met.where("not indexed").unionByName(anti(known, shown, [*FILE, "line", "token"])).unionByName(semi(meant, itself, ["meant", *FILE, "line"]).drop("meant"))
    found = met.select("symbol_id", *FILE, "target_package_id", "line", "own", "dev", "in_test", "in_docs")
    found = found.unionByName(_default_imports(a, base, exported, listed, imports, manifests).join(listed.select(*FILE, "in_test", "in_docs"), FILE).select(found.columns))

    found = marked(found, a.test_support_symbols, ["symbol_id"], "support")
    tests = ~F.col("in_test") | F.col("dev") | (F.col("support") & ~F.col("own")) | F.lit(a.policy.count_tests)
    docs = ~F.col("in_docs") | F.lit(a.policy.count_docs)
    # the line of the definition is no use of it
    place = base.select("symbol_id", F.col("own_file").alias("file"), (F.col("line") + 1).alias("line"))
    found = found.where(tests & docs)
    found = found.where("not own").unionByName(anti(found.where("own"), place, ["symbol_id", "file", "line"]))
    own_names = names.where("member_id is null")
    more = quoted_hits(a, own_names, files).unionByName(crossing_hits(a, own_names, files))
    return found.select("symbol_id", _label().alias("package_id"), "file", "line").unionByName(unread).unionByName(lost).unionByName(more).distinct()


def _label() -> Column:
    return F.when(F.col("package_id") == F.col("target_package_id"), "self").otherwise(F.col("package_id"))


def _by_name(files: DataFrame, wanted: list[str], a: Analysis) -> DataFrame:
    """Files of a class by their path alone, for those that the index did not see."""
    found = files.select(*FILE).where(globs.matches(F.col("file"), wanted))
    p = a.t["packages"].select("package_id", "manager", F.concat(F.when(F.col("path") == ".", "").otherwise(F.concat("path", F.lit("/"))), F.lit("lib/")).alias("lib"))
    return found.join(p, "package_id").where((F.col("manager") != "pub") | ~F.col("file").startswith(F.col("lib"))).select(*FILE)


def _default_imports(a: Analysis, base: DataFrame, exported: DataFrame, files: DataFrame, imports: DataFrame, manifests: DataFrame | None) -> DataFrame:
    """Lines where a file binds the default export of a package through a specifier that reaches the symbol's."""
    npm = base.where("manager = 'npm'")
    own = npm.where("token = 'default'").select("symbol_id", F.col("own_file").alias("file"))
    through = semi(exported.where("exported_as = 'default'"), npm, "symbol_id").select("symbol_id", F.col("entry_file").alias("file"))
    forms = reaching_forms(a, own.unionByName(through), manifests).join(base.select("symbol_id", "target_package_id"), "symbol_id")
    target = a.t["packages"].where("manager = 'npm'").select(F.col("package_id").alias("target_package_id"), "name")
    bound = files.select(*FILE, F.inline("defaults")).withColumn("name", bare_package(F.col("specifier")))
    bound = bound.withColumn("rest", F.expr("substr(specifier, length(name) + 1)")).withColumn("subpath", F.when(F.col("rest") != "", F.col("rest"))).join(target, "name")
    given = specifier_forms(bound)
    met = given.join(forms, ["target_package_id", "form", "value"]).select(*FILE, "target_package_id", "symbol_id", "line")
    anything = given.where("form = 'any'").join(forms.select("symbol_id", "target_package_id").distinct(), "target_package_id").select(*FILE, "target_package_id", "symbol_id", "line")
    of = imports.groupBy(*FILE, "target_package_id").agg(F.bool_or("own").alias("own"), F.bool_or("dev").alias("dev"))
    return met.unionByName(anything).distinct().join(of, [*FILE, "target_package_id"])


def apply_witness(a: Analysis, findings: DataFrame, files: DataFrame, manifests: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings, witness_ok): pending reviews become candidates where no text names them, else keep up to five places as reasons."""
    waiting = (F.col("verdict") == "needs_review") & F.array_contains("reasons", "witness_pending")
    pending = findings.where(waiting)
    hits = witness_hits(a, pending, files, manifests)
    # a checkout that could not be read is one place
    place = F.struct("package_id", F.when(F.col("line") == 0, "").otherwise(F.col("file")).alias("file"), "line")
    found = hits.groupBy("symbol_id").agg(F.slice(F.sort_array(F.collect_set(place)), 1, MAX_REASONS).alias("places"))
    where = lambda p: F.when(p["line"] == 0, "checkout missing").otherwise(F.concat_ws(":", p["file"], p["line"]))
    text = F.transform("places", lambda p: F.concat_ws(":", F.lit("witness_mismatch"), p["package_id"], where(p)))
    home = a.t["symbols"].select("symbol_id", "package_id")
    f = marked(findings.join(found, "symbol_id", "left").join(home, "symbol_id"), a.private_packages, ["package_id"], "private")
    clear = waiting & F.col("places").isNull()
    verdict = F.when(clear & F.col("private"), "deletion_candidate").when(clear, "deprecation_candidate").otherwise(F.col("verdict"))
    without = F.array_except("reasons", F.array(F.lit("witness_pending")))
    reasons = F.when(clear, without).when(waiting, F.concat(without, text)).otherwise(F.col("reasons"))
    out = f.select("symbol_id", verdict.alias("verdict"), reasons.alias("reasons"), "blocked_by")
    ok = f.where(clear).select("symbol_id", F.lit(a.policy.now).cast("long").alias("checked_at"))
    return out, ok


def propagate(a: Analysis, findings: DataFrame) -> DataFrame:
    """After the witness: reconcile islands and recompute the privately dead."""
    settled, alive = a.reconcile_islands(materialize(findings.where("verdict <> 'private_dead'")))
    return settled.unionByName(a.private_dead(settled, alive))
