"""Enrichment: edges derived from nodes by joins on names - calls, imports, references, types, dispatch, routes.

Each resolver reads nodes (and edges) and returns edges (src, dst, edge_type, metadata); each source has one target of
each strategy, the least id, and strategies come in order. Languages differ in how an import's text names a module.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.attributes import json_attribute, parent_dir
from ..graph import Graph
from ..scratch import settled
from .code_queries import CALLS
from .joins import meet, product
from .traverse import reach, steps

SOURCE_SUFFIXES = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.js")
#: Types that name no declaration.
PRIMITIVES = ("int", "int32", "int64", "uint", "float32", "float64", "string", "str", "bool", "boolean", "byte", "char", "short", "long", "double", "float", "void", "error", "any", "object", "number", "null", "undefined", "None", "Unit", "String", "Int", "Bool", "Void", "Any", "rune")


def _meta(key: str) -> Column:
    return json_attribute(F.col("metadata"), key)


def _nodes(g: Graph, *types: str) -> DataFrame:
    return g.nodes.where(F.col("node_type").isin(*types))


def _edges(pairs: DataFrame, kind: str | Column, via: str, distinct: bool = True) -> DataFrame:
    """Edges from (src, dst), one for each pair, with how they were resolved. distinct=False: each pair comes once."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    made = pairs.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst", kind.alias("edge_type"), F.lit(f'{{"resolvedVia":"{via}"}}').alias("metadata"))
    return made.distinct() if distinct else made


def _index(df: DataFrame, *keys: str) -> DataFrame:
    """One declaration for each key: the least id."""
    return df.groupBy(*keys).agg(F.min("id").alias("dst"))


def _first(strategies: list[DataFrame]) -> DataFrame:
    """(src, dst): for each source the target of the first strategy that has one."""
    ranked = [s.select("src", "dst", F.lit(i).alias("rank")) for i, s in enumerate(strategies)]
    return reduce(DataFrame.union, ranked).groupBy("src").agg(F.min(F.struct("rank", "dst"))["dst"].alias("dst"))


def class_of(node_id: Column) -> Column:
    """The class in a node's id: '...[in:Class...]' or '->CLASS->Class->'."""
    inner, scoped = F.regexp_extract(node_id, r"\[in:([^\],]+)", 1), F.regexp_extract(node_id, r"->(?:CLASS->)?([A-Z]\w*)->", 1)
    return F.when(inner != "", inner).when(scoped != "", scoped)


# --- imports --------------------------------------------------------------------------------------------------------


def joined_path(folder: Column, relative: Column) -> Column:
    """A relative path from a folder, its '.' and '..' steps taken."""
    both = F.when(folder == "", relative).otherwise(F.concat(folder, F.lit("/"), relative))
    parts = F.filter(F.split(both, "/"), lambda x: ~x.isin("", "."))

    def step(done: Column, x: Column) -> Column:
        return F.when((x == "..") & (F.size(done) > 0), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x)))

    return F.concat_ws("/", F.aggregate(parts, F.array().cast("array<string>"), step))


def module_key(style: str, source: Column, file: Column, prefix: str = "") -> Column:
    """The text that an import and a module of one language meet on: for imports from their source."""
    if style == "path":  # ./a/b from the importing file
        return joined_path(parent_dir(file), source)
    if style == "dotted":  # a.b.C
        return source
    if style == "crate":  # crate::a::b
        return F.regexp_replace(F.regexp_replace(source, "^(crate|self|super)::", ""), "::", "/")
    if style == "go":  # module/path below go.mod's name
        return F.when(source.startswith(prefix + "/"), F.substr(source, F.lit(len(prefix) + 2)))
    if style == "namespace":  # A\\B\\C
        return F.regexp_replace(F.regexp_replace(source, r"^\\", ""), r"\\", "/")
    return source


def _by_path(modules: DataFrame) -> DataFrame:
    """(id, file, key): modules by path, with or without suffix or as index."""
    shapes = [F.col("file"), *(F.when(F.col("file").endswith(s), F.expr(f"substr(file, 1, length(file) - {len(s)})")) for s in SOURCE_SUFFIXES)]
    return modules.select("id", "file", F.explode(F.array_distinct(F.array(*shapes))).alias("key")).where("key IS NOT NULL")


def import_edges(g: Graph, style: str = "path", prefix: str = "") -> DataFrame:
    """IMPORTS_FROM from imports to what they name. path: files with or without suffix or as index; dotted, crate and
    namespace: declarations by qualified name, else modules by path; go: any module of a package folder; name: modules
    by name."""
    read_once = F.inline(F.array(F.struct(F.coalesce(_meta("source"), "name").alias("source"))))  # a filter on it does not parse the metadata again
    imports = _nodes(g, "IMPORT", "IMPORT_BINDING").select(F.col("id").alias("src"), "file", read_once)
    modules = _nodes(g, "MODULE")
    if style == "path":
        keyed = imports.where(F.col("source").startswith(".")).select("src", module_key(style, F.col("source"), F.col("file")).alias("key"))
        index = _by_path(modules).select("id", "key")
    elif style == "go":
        keyed = imports.select("src", module_key(style, F.col("source"), F.col("file"), prefix).alias("key"))
        index = modules.select("id", parent_dir(F.col("file")).alias("key"))
    elif style == "name":
        keyed = imports.select("src", F.col("source").alias("key"))
        index = modules.select("id", F.col("name").alias("key"))
    else:
        keyed = imports.select("src", module_key(style, F.col("source"), F.col("file")).alias("key"))
        separator = {"dotted": ".", "crate": "/", "namespace": "/"}[style]
        declared = _nodes(g, "CLASS", "INTERFACE", "FUNCTION", "STRUCT", "ENUM", "TRAIT", "OBJECT").select("id", F.concat_ws(separator, F.coalesce(_meta("package"), _meta("namespace"), _meta("module")), "name").alias("key"))
        path = F.regexp_replace(F.regexp_replace("file", r"\.\w+$", ""), "/(__init__|mod|lib|index)$", "")
        named = modules.select("id", (F.regexp_replace(path, "/", ".") if style == "dotted" else F.regexp_replace(path, "^src/", "")).alias("key"))
        index = declared.union(named)
    return _edges(meet(keyed, _index(index, "key"), "key"), "IMPORTS_FROM", f"import-{style}")


def include_edges(g: Graph, include_paths: Iterable[str] = ()) -> DataFrame:
    """IMPORTS_FROM of #include: relative to the file, then below each include path in order."""
    own = _nodes(g, "INCLUDE", "IMPORT").select(F.col("id").alias("src"), "file", F.coalesce(_meta("path"), "name").alias("path"))
    files = _index(_nodes(g, "MODULE").select("id", F.col("file").alias("key")), "key")
    keys = [joined_path(parent_dir(F.col("file")), F.col("path")), *(joined_path(F.lit(p.rstrip("/")), F.col("path")) for p in include_paths)]
    return _edges(_first([own.select("src", k.alias("key")).join(files, "key") for k in keys]), "IMPORTS_FROM", "include")


# --- references and calls -------------------------------------------------------------------------------------------


def _called(g: Graph) -> DataFrame:
    """(src, file, callee, object, member): object and member split at the first dot."""
    dotted = F.col("name").contains(".")
    return _nodes(g, *CALLS).select(F.col("id").alias("src"), "file", F.col("name").alias("callee"), F.when(dotted, F.substring_index("name", ".", 1)).alias("object"), F.when(dotted, F.regexp_replace("name", r"^[^.]*\.", "")).alias("member"))


def _methods(g: Graph) -> DataFrame:
    own = F.coalesce(_meta("className"), class_of(F.col("id")))
    return _nodes(g, "METHOD", "FUNCTION").select("id", "file", own.alias("class"), "name").where("class IS NOT NULL")


def same_file_calls(g: Graph) -> DataFrame:
    """CALLS within a file: a function of the name (before a variable of it), a class for a capital, this.m and super.m
    in the caller's class, Class.m; names that are imported are left to other resolvers."""
    c = _called(g)
    imported = _nodes(g, "IMPORT_BINDING").select("file", F.col("name").alias("callee")).distinct()
    free = c.where("object IS NULL").join(imported, ["file", "callee"], "left_anti")
    by_name = lambda *types: _index(_nodes(g, *types).select("id", "file", F.col("name").alias("callee")), "file", "callee")
    methods = _index(_methods(g).withColumnRenamed("name", "member"), "file", "class", "member")
    own = c.where(F.col("object").isin("this", "super", "self")).withColumn("class", class_of(F.col("src")))
    static = c.where(F.col("object").rlike("^[A-Z]")).withColumn("class", F.col("object"))
    return _edges(
        _first([
            free.join(by_name("FUNCTION"), ["file", "callee"]),
            free.join(by_name("VARIABLE", "CONSTANT"), ["file", "callee"]),
            free.where(F.col("callee").rlike("^[A-Z]")).join(by_name("CLASS"), ["file", "callee"]),
            own.join(methods, ["file", "class", "member"]),
            static.join(methods, ["file", "class", "member"]),
        ]), "CALLS", "same-file-calls",
    )


def cross_file_calls(g: Graph) -> DataFrame:
    """CALLS over relative imports: call -> import binding of its name (or of its object, for namespace imports) ->
    the export of that name in the file that the import names; 'default' meets default exports."""
    read_once = F.inline(F.array(F.struct(_meta("source").alias("source"), F.coalesce(_meta("importedName"), "name").alias("imported"))))
    bindings = _nodes(g, "IMPORT_BINDING").select("file", F.col("name").alias("local"), read_once).where(F.col("source").startswith("."))
    keyed = bindings.select("file", "local", "imported", (F.col("imported") == "*").alias("spaced"), module_key("path", F.col("source"), F.col("file")).alias("key"))
    targets = _by_path(_nodes(g, "MODULE")).groupBy("key").agg(F.min(F.struct("id", "file"))["file"].alias("target"))
    bound = meet(keyed, targets, "key").select("file", "local", "imported", "spaced", "target")
    exported = _nodes(g, "EXPORT", "EXPORT_BINDING").select("id", "file", F.coalesce(_meta("exportedName"), "name").alias("wanted"))
    flagged = g.nodes.where("exported").where(F.col("node_type").isin("FUNCTION", "CLASS", "VARIABLE", "CONSTANT")).select("id", "file", F.col("name").alias("wanted"))
    exports = _index(exported.union(flagged).withColumnRenamed("file", "target"), "target", "wanted")
    c = _called(g)
    named = c.select("src", "file", F.coalesce("object", "callee").alias("local"), F.col("object").isNotNull().alias("spaced"), "member").join(bound, ["file", "local", "spaced"])
    wanted = named.select("src", "target", F.when(F.col("spaced"), F.col("member")).otherwise(F.col("imported")).alias("wanted"))
    return _edges(meet(wanted, exports, "target", "wanted"), "CALLS", "cross-file-calls")


def local_references(g: Graph, known_globals: Iterable[str] = (), types: tuple[str, ...] = ("VARIABLE", "CONSTANT", "FUNCTION", "CLASS", "PARAMETER")) -> DataFrame:
    """READS_FROM from a reference to the declaration of its name in its file; imported and global names are left."""
    refs = _nodes(g, "REFERENCE").where(~F.col("name").isin(*known_globals)).select(F.col("id").alias("src"), "file", "name")
    imported = _nodes(g, "IMPORT_BINDING").select("file", "name").distinct()
    index = _index(_nodes(g, *types).select("id", "file", "name"), "file", "name")
    return _edges(refs.join(imported, ["file", "name"], "left_anti").join(index, ["file", "name"]), "READS_FROM", "local-refs")


def table_references(g: Graph, table: Iterable[str], prefix: str, kind: str = "RESOLVES_TO", types: tuple[str, ...] = ("REFERENCE", *CALLS)) -> Graph:
    """Uses of builtins or globals: one node `prefix:name` for each name in use and an edge to it from each use."""
    names = g.spark.createDataFrame([(n,) for n in table], "base string")
    first = F.substring_index("name", ".", 1)
    used = _nodes(g, *types).select(F.col("id").alias("src"), first.alias("base")).join(F.broadcast(names), "base")  # a fixed list
    nodes = used.select(F.concat(F.lit(prefix + ":"), "base").alias("id"), F.lit(prefix).alias("node_type"), F.col("base").alias("name"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("boolean").alias("exported"), F.lit(None).cast("long").alias("content_hash"), F.lit(None).cast("string").alias("metadata")).distinct()
    return Graph(nodes, _edges(used.select("src", F.concat(F.lit(prefix + ":"), "base").alias("dst")), kind, prefix.lower()))


def property_access(g: Graph) -> DataFrame:
    """READS_FROM from this.p, Class.p and namespace.p, in this order."""
    p = _nodes(g, "PROPERTY_ACCESS").select(F.col("id").alias("src"), "file", F.substring_index("name", ".", 1).alias("object"), F.regexp_replace("name", r"^[^.]*\.", "").alias("name"), class_of(F.col("id")).alias("own"))
    members = _index(_nodes(g, "PROPERTY", "METHOD", "VARIABLE", "CONSTANT").select("id", "file", F.coalesce(_meta("className"), class_of(F.col("id"))).alias("class"), "name").where("class IS NOT NULL"), "file", "class", "name")
    spaces = _nodes(g, "IMPORT_BINDING").where(_meta("importedName") == "*").select(F.col("id").alias("dst"), "file", F.col("name").alias("object"))
    return _edges(_first([
        p.where("object IN ('this', 'self')").withColumn("class", F.col("own")).join(members, ["file", "class", "name"]),
        p.withColumn("class", F.col("object")).join(members, ["file", "class", "name"]),
        p.join(spaces, ["file", "object"]),
    ]), "READS_FROM", "property-access")


def typed_calls(g: Graph, language: str | None = None, other: str | None = None) -> DataFrame:
    """CALLS and INSTANTIATES by ordered strategies: constructors by class name; Type.m; a receiver of a known type,
    through the types above it; a free function of the file, then of the package. With two languages only calls of one
    into declarations of the other."""
    c = _nodes(g, *CALLS, "CONSTRUCTOR_CALL")
    d = g.nodes
    if language and other:
        c, d = c.where(_meta("language") == language), d.where(_meta("language") == other)
    package = F.coalesce(_meta("package"), parent_dir(F.coalesce("file", F.lit(""))))
    c = c.select(F.col("id").alias("src"), "node_type", "file", package.alias("package"), "name", F.coalesce(_meta("receiverType"), _meta("receiver_type")).alias("of"), F.coalesce(_meta("receiver"), F.when(F.col("name").contains("."), F.regexp_replace("name", r"\.[^.]*$", ""))).alias("receiver"), F.substring_index("name", ".", -1).alias("member"))
    classes = d.where(F.col("node_type").isin("CLASS", "STRUCT", "OBJECT", "ENUM", "INTERFACE"))
    by_name = _index(classes.select("id", F.col("name").alias("class")), "class")
    methods = d.where(F.col("node_type").isin("METHOD", "FUNCTION")).select("id", F.coalesce(_meta("className"), _meta("receiver"), class_of(F.col("id"))).alias("class"), F.col("name").alias("member")).where("class IS NOT NULL")
    method_index = _index(methods, "class", "member")
    functions = d.where("node_type = 'FUNCTION'").select("id", "file", package.alias("package"), F.col("name").alias("member"))
    above = reach(classes.select(F.col("id").alias("origin"), F.col("id").alias("node")), steps(g.edges, "out", ("EXTENDS", "IMPLEMENTS", "USES_TRAIT")), 10)
    names = classes.select(F.col("id").alias("node"), F.col("name").alias("class"))
    lineage = above.join(names, "node").join(names.select(F.col("node").alias("origin"), F.col("class").alias("of")), "origin").select("of", "class", "depth")
    inherited = c.where("of IS NOT NULL").join(lineage, "of").join(method_index, ["class", "member"]).groupBy("src").agg(F.min(F.struct("depth", "dst"))["dst"].alias("dst"))
    made = c.where((F.col("node_type") == "CONSTRUCTOR_CALL") | F.col("name").startswith("new ")).withColumn("class", F.regexp_replace(F.substring_index("name", ".", -1), "^new ", "")).join(by_name, "class")
    calls = c.join(made.select("src"), "src", "left_anti")
    found = _first([
        calls.withColumn("class", F.col("receiver")).join(method_index, ["class", "member"]).select("src", "dst"),
        inherited.join(made.select("src"), "src", "left_anti"),
        calls.where("receiver IS NULL").join(_index(functions, "file", "member"), ["file", "member"]).select("src", "dst"),
        calls.where("receiver IS NULL").join(_index(functions, "package", "member"), ["package", "member"]).select("src", "dst"),
    ])
    return _edges(made.select("src", "dst"), "INSTANTIATES", "typed-calls").union(_edges(found, "CALLS", "typed-calls"))


# --- types ----------------------------------------------------------------------------------------------------------

#: Metadata keys that name types, by the edge they make.
TYPE_KEYS = {"EXTENDS": ("extends", "bases", "superclass", "base_classes"), "IMPLEMENTS": ("implements", "protocols"), "TYPE_OF": ("type", "annotation"), "RETURNS": ("returnType", "return_type"), "THROWS": ("throws",), "USES_TRAIT": ("traits",), "TYPE_ALIAS": ("target_type",)}
TYPES = ("CLASS", "INTERFACE", "STRUCT", "ENUM", "TRAIT", "TYPE", "TYPE_ALIAS", "PROTOCOL", "OBJECT")


def names_in(text: Column) -> Column:
    """The names in a list of types: split at commas outside generics, generics, pointers and packages taken off."""
    flat = F.regexp_replace(F.regexp_replace(text, r"<[^<>]*(?:<[^<>]*>[^<>]*)*>", ""), r"[\[\]\"*&?]|\b(const|virtual|public|private|protected)\b", "")
    return F.transform(F.split(flat, ","), lambda x: F.substring_index(F.substring_index(F.trim(x), ".", -1), "::", -1))


def type_edges(g: Graph, kinds: Iterable[str] = tuple(TYPE_KEYS), across: bool = False) -> DataFrame:
    """Edges from declarations to the types that their metadata names: in the same file first, then the same
    directory, then anywhere. across: only between languages. Primitive types are passed over."""
    kinds = list(kinds)
    raw = lambda key: F.coalesce(json_attribute(F.col("metadata"), key), F.get_json_object("metadata", "$['" + key + "']"))
    texts = F.array(*(F.struct(F.lit(k).alias("kind"), F.coalesce(*(raw(key) for key in TYPE_KEYS[k])).alias("text")) for k in kinds))
    wanted = g.nodes.select(F.col("id").alias("src"), "file", _meta("language").alias("language"), F.explode(texts).alias("t")).where("t.text IS NOT NULL")
    wanted = wanted.select("src", "file", "language", "t.kind", F.explode(names_in(F.col("t.text"))).alias("name")).where((F.col("name") != "") & ~F.col("name").isin(*PRIMITIVES))
    declared = _nodes(g, *TYPES).select("id", F.col("file").alias("there"), _meta("language").alias("speaks"), "name")
    met = wanted.join(declared, "name").where("src != id")
    if across:
        met = met.where(F.coalesce(F.col("language") != F.col("speaks"), F.lit(False)))
    rank = F.when(F.col("file") == F.col("there"), 0).when(parent_dir(F.col("file")) == parent_dir(F.col("there")), 1).otherwise(2)
    best = met.groupBy("src", "kind", "name").agg(F.min(F.struct(rank.alias("rank"), "id"))["id"].alias("dst"))
    return _edges(best, F.col("kind"), "types")


# Type hints that name no declaration, in lower case, and those that name the class around them.
HINT_PRIMITIVES = ("string", "int", "integer", "float", "double", "bool", "boolean", "array", "void", "mixed", "callable", "object", "iterable", "never", "null", "false", "true", "parent")
HINT_SELF = ("self", "static")


def hinted_types(g: Graph) -> DataFrame:
    """TYPE_OF from variables (metadata type) and RETURNS from functions (return_type) to the declaration that the hint
    names: of a union the first part that is no primitive, without a leading '?'; self and static are the class of the
    function. A name with a backslash is whole; any other is sought in the file's namespace, then as the file's import
    of that name or, without one, as a global name."""
    kind = F.col("node_type")
    hint = F.when(kind == "VARIABLE", _meta("type")).when(kind == "FUNCTION", _meta("return_type"))
    parts = F.transform(F.split(F.regexp_replace(F.trim(hint), r"^\?", ""), r"\|"), lambda x: F.trim(x))
    own = lambda x: F.lower(x).isin(*HINT_SELF)
    named = F.get(F.filter(parts, lambda x: (x != "") & (own(x) | ~F.lower(x).isin(*HINT_PRIMITIVES))), F.lit(0))
    hinted = _nodes(g, "VARIABLE", "FUNCTION").select(F.col("id").alias("src"), "node_type", "file", named.alias("name"), F.regexp_extract("id", r"\[in:([^\],]+)", 1).alias("inside")).where("name IS NOT NULL")
    # A variable stands in a function, which stands in a class; a function stands in its class.
    classes = _nodes(g, "FUNCTION").select("file", F.col("name").alias("inside"), F.regexp_extract("id", r"\[in:([^\],]+)", 1).alias("of")).where("of != ''").groupBy("file", "inside").agg(F.min("of").alias("of"))
    around = F.when(F.col("node_type") == "FUNCTION", F.nullif(F.col("inside"), F.lit(""))).otherwise(F.col("of"))
    asked = hinted.join(classes, ["file", "inside"], "left").withColumn("name", F.when(own(F.col("name")), around).otherwise(F.col("name"))).where("name IS NOT NULL")
    spaces = _nodes(g, "MODULE").groupBy("file").agg(F.min(F.coalesce(_meta("namespace"), F.lit(""))).alias("space"))
    imports = _nodes(g, "IMPORT_BINDING").select("file", "name", _meta("source").alias("source")).groupBy("file", "name").agg(F.min("source").alias("source"))
    whole = lambda space, name: F.when(F.coalesce(space, F.lit("")) == "", name).otherwise(F.concat(space, F.lit("\\"), name))
    declared = _nodes(g, "CLASS", "INTERFACE", "TRAIT", "ENUM").select("id", "file", "name", _meta("namespace").alias("own")).join(spaces, "file", "left")
    index = _index(declared.select("id", whole(F.coalesce("own", "space"), F.col("name")).alias("key")), "key")
    placed = asked.join(spaces, "file", "left").join(imports, ["file", "name"], "left")
    qualified = F.col("name").contains("\\")
    first = placed.withColumn("key", F.when(qualified, F.col("name")).otherwise(whole(F.col("space"), F.col("name"))))
    second = placed.where(~qualified).withColumn("key", F.coalesce("source", "name"))
    found = _first([x.join(index, "key").select("src", "dst") for x in (first, second)])
    typed = found.join(hinted.select("src", "node_type"), "src")
    return _edges(typed, F.when(kind == "VARIABLE", "TYPE_OF").otherwise("RETURNS"), "type-hints")


def bridges(g: Graph, one: str, two: str) -> DataFrame:
    """BRIDGES_TO between classes of one name in two languages."""
    side = lambda lang, column: _nodes(g, "CLASS").where(_meta("language") == lang).select(F.col("id").alias(column), "name")
    return _edges(side(one, "src").join(side(two, "dst"), "name"), "BRIDGES_TO", "bridge")


def annotation_edges(g: Graph) -> DataFrame:
    """ANNOTATION_RESOLVES_TO from an attribute to the annotation type of its name."""
    own = _nodes(g, "ATTRIBUTE", "ANNOTATION").select(F.col("id").alias("src"), F.substring_index(F.regexp_replace("name", "^@", ""), ".", -1).alias("name"))
    index = _index(_nodes(g, "ANNOTATION_TYPE", "INTERFACE", "CLASS").select("id", "name"), "name")
    return _edges(meet(own, index, "name").where("src != dst"), "ANNOTATION_RESOLVES_TO", "annotations")


def template_edges(g: Graph) -> DataFrame:
    """INSTANTIATES_TEMPLATE from uses, SPECIALIZES from specializations, to the primary template of the name."""
    primary = _index(_nodes(g, "TEMPLATE").where(_meta("primary_template").isNull()).select("id", F.col("name").alias("template")), "template")
    uses = _nodes(g, "TEMPLATE_USE", "TYPE_REFERENCE").select(F.col("id").alias("src"), F.coalesce(_meta("template_name"), F.regexp_extract("name", r"^([\w:]+)\s*<", 1)).alias("template"))
    special = _nodes(g, "TEMPLATE").select(F.col("id").alias("src"), _meta("primary_template").alias("template")).where("template IS NOT NULL")
    return _edges(meet(uses, primary, "template"), "INSTANTIATES_TEMPLATE", "templates").union(_edges(special.join(primary, "template"), "SPECIALIZES", "templates"))


def operator_calls(g: Graph) -> DataFrame:
    """CALLS from uses of an overloaded operator to the member of the left type, else to the free operator."""
    uses = _nodes(g, "OPERATOR_CALL", "EXPRESSION").select(F.col("id").alias("src"), F.concat(F.lit("operator"), _meta("operator")).alias("name"), F.coalesce(_meta("receiverType"), _meta("left_type")).alias("class")).where("name IS NOT NULL")
    own = _nodes(g, "METHOD", "FUNCTION").where(F.col("name").startswith("operator")).select("id", "name", F.coalesce(_meta("className"), class_of(F.col("id"))).alias("class"))
    return _edges(_first([meet(uses, _index(own.where("class IS NOT NULL"), "name", "class"), "name", "class"), meet(uses, _index(own.where("class IS NULL"), "name"), "name")]), "CALLS", "operators", distinct=False)


#: Structs of a method, about, that stand in one list.
LISTED = 4096


def interface_satisfaction(methods: DataFrame, wanted: DataFrame) -> DataFrame:
    """(struct, interface): relational division of methods (struct, method) by wanted (interface, method): structs
    whose methods hold all of an interface's. Interfaces without methods are met by none.

    Structs of equal methods are divided as one, and so are interfaces; what they stand for is put back at the end. An
    interface takes the list of structs of its rarest method to the list of its second rarest; only the structs in both
    are compared on the others. Lists of common methods are cut by hash, into a power of two, so that a part of one list
    lies in whole parts of a longer one.
    """
    group = lambda df, member, own: settled(df.groupBy(member).agg(F.array_sort(F.collect_set("method")).alias(own), F.bool_or(F.col("method").isNull()).alias("odd")), "sets")
    structs, interfaces = group(methods.select("struct", "method"), "struct", "own"), group(wanted.select("interface", "method"), "interface", "need").where("not odd")
    sets = structs.groupBy("own").agg(F.min("struct").alias("s"), F.count(F.lit(1)).alias("n"))
    asked = settled(interfaces.groupBy("need").agg(F.min("interface").alias("i"), F.count(F.lit(1)).alias("n")), "asked")
    held = settled(sets.select("s", F.explode("own").alias("method")), "held")
    counts = held.groupBy("method").agg(F.count(F.lit(1)).alias("c"))
    parts = F.when(F.col("c") <= LISTED, 1).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2(F.col("c") / LISTED)))).cast("int")
    counts = settled(counts.withColumn("parts", parts), "counts")
    lists = settled(meet(held, counts, "method").groupBy("method", "parts", F.pmod(F.xxhash64("s"), F.col("parts")).cast("int").alias("part")).agg(F.collect_list("s").alias("ss")), "lists")

    # Each interface's methods, the rarest first; an interface with a method that no struct has drops out.
    ranked = meet(asked.select("i", "n", F.size("need").alias("size"), F.explode("need").alias("method")), counts, "method")
    ranked = ranked.groupBy("i", "n", "size").agg(F.array_sort(F.collect_list(F.struct("c", "method", "parts"))).alias("by")).where(F.size("by") == F.col("size"))
    second = F.get("by", F.lit(1))
    probe = ranked.select("i", "n", "size", F.col("by")[0]["method"].alias("method"), second["method"].alias("next"), second["parts"].alias("cut"), F.slice(F.col("by")["method"], 3, 1 << 30).alias("rest"))
    first = probe.join(lists.select("method", "ss").hint("shuffle_hash"), "method")
    cut = F.when(F.col("cut") == 1, F.array(F.lit(0))).otherwise(F.array_distinct(F.transform("ss", lambda x: F.pmod(F.xxhash64(x), F.col("cut")).cast("int"))))
    carried = first.where("size > 1").select("i", "n", "rest", F.col("next").alias("method"), "cut", "ss", F.explode(cut).alias("part"))
    carried = carried.withColumn("ss", F.when(F.col("cut") == 1, F.col("ss")).otherwise(F.filter("ss", lambda x: F.pmod(F.xxhash64(x), F.col("cut")) == F.col("part"))))
    both = carried.join(lists.select("method", "part", F.col("ss").alias("others")).hint("shuffle_hash"), ["method", "part"]).select("i", "n", "rest", F.explode(F.array_intersect("ss", "others")).alias("s"))
    both = settled(both, "both")
    left = both.where(F.size("rest") > 0)
    whole = left.select("i", "n", "s", F.size("rest").alias("k"), F.explode("rest").alias("method")).join(held, ["s", "method"]).groupBy("i", "n", "s", "k").agg(F.count(F.lit(1)).alias("f")).where("f = k")
    single = first.where("size = 1").select("i", "n", F.explode("ss").alias("s"))
    pairs = settled(reduce(DataFrame.union, [x.select("i", "n", "s") for x in (single, both.where(F.size("rest") == 0), whole)]), "pairs")

    members = settled(interfaces.join(asked.where("n > 1").select("need", "i"), "need").select("i", "interface"), "members")
    met = pairs.where("n = 1").select("s", F.col("i").alias("interface"))
    if not members.isEmpty():
        met = settled(met.union(product(members, pairs.where("n > 1"), "i", "interface", "s").select("s", "interface")), "met")
    alike = settled(structs.join(sets.where("n > 1").select("own", "s"), "own").select("s", "struct"), "alike")
    if alike.isEmpty():
        return met.select(F.col("s").alias("struct"), "interface")
    shared = alike.select("s").distinct()
    alone = met.join(shared.hint("shuffle_hash"), "s", "left_anti").select(F.col("s").alias("struct"), "interface")
    return alone.union(product(met.join(shared.hint("shuffle_hash"), "s", "left_semi"), alike, "s", "interface", "struct").select("struct", "interface"))


def implements_by_structure(g: Graph) -> DataFrame:
    """IMPLEMENTS from structs to the interfaces of the graph that their methods satisfy."""
    held = lambda kind, column: _nodes(g, kind).select(F.col("id").alias(column)).join(g.edges.where("edge_type IN ('HAS_METHOD', 'CONTAINS', 'DECLARES')").select(F.col("src").alias(column), "dst"), column).join(_nodes(g, "METHOD", "FUNCTION").select(F.col("id").alias("dst"), F.col("name").alias("method")), "dst")
    return _edges(interface_satisfaction(held("STRUCT", "struct"), held("INTERFACE", "interface")).select(F.col("struct").alias("src"), F.col("interface").alias("dst")), "IMPLEMENTS", "structure", distinct=False)


def behaviours(g: Graph) -> DataFrame:
    """IMPLEMENTS from modules to the behaviour they declare, and from Protocol.Type modules to the protocol."""
    modules = _nodes(g, "MODULE").select("id", "name", _meta("behaviour").alias("behaviour"))
    index = _index(modules.select("id", "name"), "name")
    declared = modules.select(F.col("id").alias("src"), F.col("behaviour").alias("name")).transform(meet, index, "name")
    protocols = _nodes(g, "PROTOCOL", "MODULE").where((F.col("node_type") == "PROTOCOL") | (_meta("protocol") == "true"))
    named = modules.where(F.col("name").contains(".")).select(F.col("id").alias("src"), F.regexp_replace("name", r"\.[^.]*$", "").alias("name")).transform(meet, _index(protocols.select("id", "name"), "name"), "name")
    return _edges(declared.union(named.select(*declared.columns)).where("src != dst"), "IMPLEMENTS", "behaviours")


def virtual_dispatch(g: Graph, depth: int = 20) -> DataFrame:
    """OVERRIDES from a method to the method of its name in the nearest class above, and DISPATCHES_TO from calls of
    a method to each override below it."""
    of_class = g.edges.where("edge_type IN ('HAS_METHOD', 'CONTAINS', 'DECLARES')").select(F.col("src").alias("class"), F.col("dst").alias("method"))
    methods = of_class.join(_nodes(g, "METHOD", "FUNCTION").select(F.col("id").alias("method"), "name"), "method")
    classes = _nodes(g, "CLASS", "STRUCT", "INTERFACE").select(F.col("id").alias("origin"), F.col("id").alias("node"))
    above = reach(classes, steps(g.edges, "out", ("EXTENDS", "IMPLEMENTS")), depth).where("depth > 0")
    higher = methods.select(F.col("class").alias("node"), F.col("method").alias("base"), "name")
    met = settled(methods.select(F.col("class").alias("origin"), "method", "name").join(above, "origin").join(higher, ["node", "name"]).select("method", "base", "depth"), "met")
    nearest = met.groupBy("method").agg(F.min(F.struct("depth", "base"))["base"].alias("dst")).select(F.col("method").alias("src"), "dst")
    # A pair comes over two bases only where the call has several and the override has several: only these pairs are compared.
    over = met.select("base", F.col("method").alias("dst")).distinct()
    calls = g.edges.where("edge_type = 'CALLS'").select("src", F.col("dst").alias("base")).distinct().join(over.select("base").distinct(), "base", "left_semi")
    many = lambda df, c: settled(df.join(df.groupBy(c).agg((F.count(F.lit(1)) > 1).alias("many")), c).select("base", F.struct(F.col(c).alias("id"), "many").alias(c)), "many")
    calls, over = many(calls, "src"), many(over, "dst")
    pair = [F.col("src.id").alias("src"), F.col("dst.id").alias("dst")]
    sent = product(over, calls, "base", "dst", "src").where("NOT (src.many AND dst.many)").select(*pair)
    twice = [x.where(f"{c}.many") for x, c in ((over, "dst"), (calls, "src"))]
    if not any(x.isEmpty() for x in twice):
        sent = sent.union(product(*twice, "base", "dst", "src").select(*pair).distinct())
    return _edges(nearest, "OVERRIDES", "virtual", distinct=False).union(_edges(sent, "DISPATCHES_TO", "virtual", distinct=False))


def context_propagation(g: Graph, context: str = "context.Context") -> DataFrame:
    """PROPAGATES_, SPAWNS_WITH_ and DEFERS_WITH_CONTEXT along CALLS between functions that both take a context."""
    takes = _nodes(g, "FUNCTION", "METHOD").where(F.coalesce(F.get_json_object("metadata", "$.params"), F.lit("")).contains(context) | (F.coalesce(_meta("acceptsContext"), F.lit("")) == "true")).select("id")
    e = g.edges.where("edge_type = 'CALLS'")
    mode = json_attribute(F.col("metadata"), "mode")
    kind = F.when(mode == "go", "SPAWNS_WITH_CONTEXT").when(mode == "defer", "DEFERS_WITH_CONTEXT").otherwise("PROPAGATES_CONTEXT")
    both = e.join(takes.withColumnRenamed("id", "src"), "src", "left_semi").join(takes.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return both.select("src", "dst", kind.alias("edge_type"), F.lit('{"resolvedVia":"context"}').alias("metadata")).distinct()


# --- services -------------------------------------------------------------------------------------------------------


def _path_parts(url: Column) -> Column:
    path = F.regexp_replace(F.regexp_replace(url, r"^https?://[^/]+", ""), r"[?#].*$", "")
    return F.filter(F.split(path, "/"), lambda x: x != "")


def match_routes(requests: DataFrame, routes: DataFrame) -> DataFrame:
    """(request, route): requests (id, method, url) and routes (id, method, path) of one method and number of path
    parts whose parts are equal or a :param, {param} or ${...} on either side. Of several, exact paths first, then
    fewest params, then the least id.

    Both sides meet on the path with the free parts of either left out: a request asks once for each shape (which parts
    are free) that the routes of its method and length have, and a route is listed once for each shape of the requests.
    Of the routes with one such path only the best counts, so a request meets one route a shape.
    """
    free = lambda x: x.rlike(r"^(:.+|\{.+\}|\$\{.*\}|<.+>|\*)$")
    mask = lambda parts: F.transform(parts, free)
    blank = lambda parts, m: F.zip_with(parts, m, lambda p, q: F.when(q, "").otherwise(p))  # noqa: E731  no part is empty
    left_out = lambda parts, m, o: F.array_join(blank(blank(parts, m), o), "/")
    side = lambda df, name, text: df.select(F.col("id").alias(name), F.upper("method").alias("method"), _path_parts(F.col(text)).alias("parts")).withColumn("n", F.size("parts")).withColumn("own", mask(F.col("parts")))
    shapes = lambda df: df.select("method", "n", "own").distinct().groupBy("method", "n").agg(F.collect_list("own").alias("shapes"))
    r, t = side(requests, "request", "url"), settled(side(routes, "route", "path"), "routes")
    asked = meet(r, shapes(t), "method", "n")
    listed = meet(t, shapes(r), "method", "n").withColumn("asker", F.explode("shapes"))
    loose = F.size(F.filter("own", lambda x: x))
    index = listed.groupBy("method", F.col("asker").alias("own"), left_out(F.col("parts"), F.col("own"), F.col("asker")).alias("key")).agg(F.min(F.struct(loose.alias("k"), "route")).alias("best"))
    keys = F.array_distinct(F.transform("shapes", lambda m: left_out(F.col("parts"), F.col("own"), m)))
    found = meet(asked.select("request", "method", "own", F.explode(keys).alias("key")), index, "method", "own", "key").select("request", F.lit(1).alias("x"), "best.k", "best.route")
    # A request with free parts may be a route's path to the letter, and then that route comes first.
    letter = t.where(F.exists("own", lambda x: x)).groupBy("method", "parts").agg(F.min(F.struct(loose.alias("k"), "route")).alias("best"))
    exact = meet(r.where(F.exists("own", lambda x: x)), letter, "method", "parts").select("request", F.lit(0).alias("x"), "best.k", "best.route")
    return found.union(exact).groupBy("request").agg(F.min(F.struct("x", "k", "route"))["route"].alias("route"))


def http_edges(g: Graph) -> DataFrame:
    """INTERACTS_WITH from requests to their routes, and HTTP_RECEIVES to what the routes respond with."""
    requests = _nodes(g, "http:request").select("id", F.coalesce(_meta("method"), F.lit("GET")).alias("method"), F.coalesce(_meta("url"), "name").alias("url"))
    routes = _nodes(g, "http:route").select("id", F.coalesce(_meta("method"), F.lit("GET")).alias("method"), F.coalesce(_meta("path"), "name").alias("path"))
    pairs = settled(match_routes(requests, routes).select(F.col("request").alias("src"), F.col("route").alias("dst")), "pairs")
    responds = g.edges.where("edge_type = 'RESPONDS_WITH'").select(F.col("src").alias("route"), F.col("dst").alias("answer"))
    received = meet(pairs.withColumnRenamed("dst", "route"), responds.distinct(), "route").select("src", F.col("answer").alias("dst"))
    return _edges(pairs, "INTERACTS_WITH", "http", distinct=False).union(_edges(received, "HTTP_RECEIVES", "http", distinct=False))


def route_rules(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """(request, rule) of requests (id, path) and rules (id, strip_prefix, priority, seq): the longest prefix that the
    path begins with at a part's end, then the lowest priority, then the first added."""
    path, prefix = F.col("path"), F.col("strip_prefix")
    hit = (path == prefix) | path.startswith(F.concat(F.rtrim(prefix, F.lit("/")), F.lit("/")))
    parts = F.split(path, "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    asked = requests.select(F.col("id").alias("request"), "path", F.explode(F.array_distinct(heads)).alias("key"))
    known = rules.select(F.col("id").alias("rule"), "strip_prefix", "priority", "seq", F.rtrim("strip_prefix", F.lit("/")).alias("key"))
    met = asked.join(known, "key").where(hit)
    return met.groupBy("request").agg(F.min(F.struct((-F.length("strip_prefix")).alias("a"), "priority", "seq", "rule"))["rule"].alias("rule"))
