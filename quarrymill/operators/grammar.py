"""Classes of the things in a grammar, by evidence: categories, roles, purposes, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Strength of each kind of evidence, in hundredths.
EVIDENCE = {"heuristic": 10, "simple_name_pattern": 20, "language": 30, "connections": 65, "categories": 80, "roles": 85, "specific_thing": 90, "purpose": 95}

#: Purposes of tokens and their class.
PURPOSE_CLASS = {"keyword": "syntax_keyword", "operator": "operation_operator", "identifier": "syntax_identifier", "literal": "syntax_literal", "punctuation": "syntax_punctuation", "comment": "documentation_structured"}

#: Roles that a node must have, and the class that follows; the first that fits counts, the more specific stand first.
ROLE_RULES = [
    ({"body", "name", "superclass"}, "definition_type"),
    ({"body", "name", "parameters"}, "definition_callable"),
    ({"body", "name"}, "definition_callable"),
    ({"condition", "consequence"}, "flow_branching"),
    ({"condition", "body"}, "flow_iteration"),
    ({"function", "arguments"}, "operation_invocation"),
    ({"left", "right"}, "operation_operator"),
]

#: Patterns of names and the class that follows; the first that fits counts.
NAME_RULES = [
    (r"(^|_)(comment|docstring)", "documentation_structured"),
    (r"(^|_)test(_|$)", "definition_test"),
    (r"(function|method|lambda|closure).*(definition|declaration|item)?$", "definition_callable"),
    (r"(class|struct|interface|trait|enum|type).*(definition|declaration|item|specifier)?$", "definition_type"),
    (r"(import|export|module|package|namespace)", "boundary_module"),
    (r"(try|catch|except|throw|raise|finally)", "boundary_error"),
    (r"(if|switch|match|case|conditional|ternary)", "flow_branching"),
    (r"(for|while|loop|do)_", "flow_iteration"),
    (r"(return|break|continue|goto|yield)", "flow_control"),
    (r"(async|await)", "flow_async"),
    (r"(call|invocation)", "operation_invocation"),
    (r"(binary|unary|assignment|operator)", "operation_operator"),
    (r"(string|number|integer|float|boolean|literal)", "syntax_literal"),
    (r"identifier", "syntax_identifier"),
    (r"(decorator|annotation|attribute)", "syntax_annotation"),
]


def confidence(strengths: Column, adjustment: Column | int = 0) -> Column:
    """The evidence's strengths added up, between 0 and 1."""
    total = F.aggregate(strengths, F.lit(0), lambda a, x: a + x) + adjustment
    return F.least(F.greatest(total, F.lit(0)) / 100.0, F.lit(1.0))


def by_roles(roles: Column) -> Column:
    out = F.lit(None).cast("string")
    for need, cls in reversed(ROLE_RULES):
        out = F.when(F.forall(F.array(*map(F.lit, sorted(need))), lambda r: F.array_contains(roles, r)), cls).otherwise(out)
    return out


def by_name(name: Column) -> Column:
    out = F.lit(None).cast("string")
    for pattern, cls in reversed(NAME_RULES):
        out = F.when(name.rlike(pattern), cls).otherwise(out)
    return out


def by_purpose(purpose: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in PURPOSE_CLASS.items() for x in kv]), purpose)


def classified(things: DataFrame) -> DataFrame:
    """``things`` (name, purpose, roles) with class and confidence: purpose before roles before name."""
    purpose, roles, name = by_purpose(F.col("purpose")), by_roles(F.col("roles")), by_name(F.col("name"))
    strength = F.when(purpose.isNotNull(), EVIDENCE["purpose"]).when(roles.isNotNull(), EVIDENCE["roles"]).when(name.isNotNull(), EVIDENCE["simple_name_pattern"]).otherwise(0)
    return things.withColumn("class", F.coalesce(purpose, roles, name)).withColumn("confidence", strength / 100.0)


#: Categories of grammars and the class of their members.
CATEGORY_CLASS = {
    "expression": "operation_operator", "primary_expression": "operation_operator", "statement": "flow_branching", "type": "definition_type", "declaration": "definition_data", "pattern": "flow_branching", "literal": "syntax_literal",
    "declarator": "definition_data", "abstract_declarator": "definition_data", "field_declarator": "definition_data", "type_declarator": "definition_data", "type_specifier": "definition_type",
    "simple_statement": "flow_control", "simple_type": "definition_type", "compound_statement": "flow_branching", "parameter": "definition_data", "argument": "syntax_annotation", "identifier": "syntax_identifier",
    "arg": "operation_operator", "call_operator": "operation_operator", "class_decl": "definition_type", "class_member_declaration": "definition_data", "constraint": "definition_type", "constraints": "definition_type", "decl": "definition_callable",
    "declaration_statement": "definition_type", "definition": "definition_callable", "expression_statement": "operation_data", "guard": "flow_branching", "instance_decl": "definition_type", "lhs": "syntax_identifier", "literal_pattern": "syntax_literal",
    "lvalue_expression": "syntax_identifier", "method_name": "syntax_identifier", "module_directive": "boundary_module", "non_lvalue_expression": "operation_operator", "nonlocal_variable": "syntax_identifier", "pattern_constant": "syntax_literal",
    "pattern_expr": "flow_branching", "pattern_expr_basic": "flow_branching", "pattern_primitive": "syntax_literal", "pattern_top_expr_body": "flow_branching", "primary": "operation_operator", "primary_type": "definition_type", "qualifier": "flow_iteration",
    "quantified_type": "definition_type", "simple_numeric": "syntax_literal", "type_declaration": "definition_type", "type_param": "definition_type", "unannotated_type": "definition_type", "value": "syntax_literal", "variable": "syntax_identifier",
}

#: Members of categories that span several classes, by language and category.
MEMBER_CLASS = {
    ("ruby", "primary"): {
        "class": "definition_type", "module": "definition_type", "singleton_class": "definition_type", "method": "definition_callable", "singleton_method": "definition_callable",
        "if": "flow_branching", "unless": "flow_branching", "case": "flow_branching", "case_match": "flow_branching", "while": "flow_iteration", "until": "flow_iteration", "for": "flow_iteration",
        "break": "flow_control", "next": "flow_control", "redo": "flow_control", "retry": "flow_control", "return": "flow_control", "yield": "flow_control", "unary": "operation_operator", "call": "operation_invocation", "lambda": "expression_anonymous",
        "simple_numeric": "syntax_literal", "character": "syntax_literal", "string": "syntax_literal", "simple_symbol": "syntax_literal", "delimited_symbol": "syntax_literal", "chained_string": "syntax_literal", "regex": "syntax_literal",
        "array": "syntax_literal", "string_array": "syntax_literal", "symbol_array": "syntax_literal", "hash": "syntax_literal", "lhs": "syntax_identifier", "begin": "syntax_punctuation", "subshell": "syntax_punctuation", "parenthesized_statements": "syntax_punctuation", "heredoc_beginning": "syntax_punctuation",
    },
    ("rust", "declaration_statement"): {
        "struct_item": "definition_type", "enum_item": "definition_type", "union_item": "definition_type", "trait_item": "definition_type", "type_item": "definition_type", "impl_item": "definition_type", "function_item": "definition_callable", "function_signature_item": "definition_callable",
        "const_item": "definition_data", "static_item": "definition_data", "let_declaration": "definition_data", "associated_type": "definition_data", "use_declaration": "boundary_module", "extern_crate_declaration": "boundary_module", "mod_item": "boundary_module", "foreign_mod_item": "boundary_module",
        "attribute_item": "syntax_annotation", "inner_attribute_item": "syntax_annotation", "macro_invocation": "definition_callable", "macro_definition": "definition_callable", "empty_statement": "syntax_punctuation",
    },
    ("scala", "definition"): {
        "function_declaration": "definition_callable", "function_definition": "definition_callable", "given_definition": "definition_callable", "class_definition": "definition_type", "trait_definition": "definition_type", "enum_definition": "definition_type", "object_definition": "definition_type", "type_definition": "definition_type", "extension_definition": "definition_type",
        "var_definition": "definition_data", "val_definition": "definition_data", "var_declaration": "definition_data", "val_declaration": "definition_data", "import_declaration": "boundary_module", "export_declaration": "boundary_module", "package_clause": "boundary_module", "package_object": "boundary_module",
    },
}

#: From here on the first stage that speaks has the last word.
CONFIDENT = 0.75
#: Evidence of each stage of the cascade, and its adjustment.
STAGES = {"exception": (140, 90), "anywhere": (130, 100), "purpose": (95, 0), "member": (120, 15), "category": (80, 0), "roles": (85, 0), "name": (50, 20), "elsewhere": (60, -20)}


def stage_confidence(stage: str) -> float:
    return max(0, min(100, sum(STAGES[stage]))) / 100


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def by_category(categories: Column) -> Column:
    """The class of the first category that has one."""
    return F.get(F.filter(F.transform(categories, lambda k: _lookup(CATEGORY_CLASS, k)), lambda x: x.isNotNull()), 0)


def by_member(name: Column, language: Column, categories: Column) -> Column:
    out = F.lit(None).cast("string")
    for (lang, category), table in MEMBER_CLASS.items():
        out = F.when((language == lang) & F.array_contains(categories, category), _lookup(table, name)).otherwise(out)
    return out


def by_exception(name: Column, language: Column) -> Column:
    """Comments, which names tell apart."""
    lower = F.lower(name)
    line = F.contains(lower, F.lit("comment")) & F.contains(lower, F.lit("line"))
    structured = lower.isin("block_comment", "multiline_comment", "comment") | ((language == "rust") & (lower == "doc_comment"))
    return F.when(line, "syntax_annotation").when(structured, "documentation_structured")


def by_anywhere(name: Column, language: Column, anywhere: Column) -> Column:
    """What may stand anywhere in a tree and isn't settled by its name alone."""
    lower = F.lower(name)
    swift = F.when(language == "swift", F.when(lower == "comment", "syntax_annotation").when(lower == "multiline_comment", "documentation_structured"))
    rest = F.when((lower == "line_continuation") & (language == "python"), "syntax_punctuation").when(lower == "text_interpolation", "syntax_identifier")
    return F.when(anywhere, F.coalesce(swift, rest))


def cascade(things: DataFrame, differentiator: Column | None = None) -> DataFrame:
    """``things`` (name, language, purpose, roles, categories, anywhere, is_file) with class, confidence and stage.

    Stages in order: exceptions, things that may stand anywhere, purposes of tokens, members of broad categories,
    categories, roles, names, and the class that most other languages surely give the name. The first confident stage
    decides; without one, the most confident. ``differentiator`` overrules the class where it isn't null.
    """
    c = F.col
    found = {
        "anywhere": by_anywhere(c("name"), c("language"), c("anywhere")), "exception": by_exception(c("name"), c("language")), "purpose": by_purpose(c("purpose")), "member": by_member(c("name"), c("language"), c("categories")),
        "category": by_category(c("categories")), "roles": by_roles(c("roles")), "name": by_name(c("name")),
    }
    own = things.withColumn("_own", F.array(*[F.struct(F.lit(stage_confidence(s)).alias("confidence"), F.lit(s).alias("stage"), k.alias("class")) for s, k in found.items()]))
    own = own.withColumn("_own", F.filter("_own", lambda x: x["class"].isNotNull()))
    sure = F.get(F.filter("_own", lambda x: x["confidence"] >= CONFIDENT), 0)
    own = own.withColumn("_best", F.coalesce(sure, F.array_max("_own")))
    # Elsewhere: votes of other languages that are sure of the name; a row for each name, language and class.
    votes = own.filter(F.col("_best.confidence") >= CONFIDENT).groupBy("name", "language", F.col("_best.class").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    asked = own.filter("_best IS NULL OR _best.confidence < 0.6").select("name", "language").distinct().withColumnRenamed("language", "_l")
    other = votes.join(asked, "name").filter(F.col("language") != F.col("_l")).groupBy("name", "_l", "class").agg(F.count(F.lit(1)).alias("n")).groupBy("name", "_l").agg(F.max(F.struct(F.col("n"), F.col("class"))).alias("_vote"))
    voted = own.join(other.withColumnRenamed("_l", "language"), ["name", "language"], "left")
    elsewhere = F.when(F.col("_vote").isNotNull(), F.struct(F.lit(stage_confidence("elsewhere")).alias("confidence"), F.lit("elsewhere").alias("stage"), F.col("_vote.class").alias("class")))
    file = F.when(c("is_file"), F.struct(F.lit(1.0).alias("confidence"), F.lit("file").alias("stage"), F.lit("file_thing").alias("class")))
    best = F.coalesce(file, F.when(F.coalesce(F.col("_best.confidence"), F.lit(0.0)) >= CONFIDENT, F.col("_best")), F.array_max(F.array_compact(F.array("_best", elsewhere))))
    out = voted.withColumn("_best", best)
    cls = F.col("_best.class") if differentiator is None else F.coalesce(differentiator, F.col("_best.class"))
    return out.select(*things.columns, cls.alias("class"), F.coalesce(F.col("_best.confidence"), F.lit(0.0)).alias("confidence"), F.col("_best.stage").alias("stage"))


def cardinality(required: Column, multiple: Column) -> Column:
    return F.when(required & multiple, "1..n").when(required, "1").when(multiple, "0..n").otherwise("0..1")


def node_types(raw: DataFrame, key: str, text: str) -> DataFrame:
    """Things and their fields from node-type JSON: key, type, named, field, required, multiple, target."""
    target = "struct<type: string, named: boolean>"
    child = f"struct<multiple: boolean, required: boolean, types: array<{target}>>"
    parsed = raw.select(key, F.explode(F.from_json(text, f"array<struct<type: string, named: boolean, fields: map<string, {child}>, children: {child}>>")).alias("n"))
    fields = parsed.select(key, "n.type", "n.named", F.explode_outer("n.fields").alias("field", "f"))
    return fields.select(key, "type", "named", "field", F.col("f.required").alias("required"), F.col("f.multiple").alias("multiple"), F.explode_outer("f.types.type").alias("target"))


#: Lines that a block of the containment join spans.
BLOCK = 64


def inside(nodes: DataFrame) -> DataFrame:
    """(file, ancestor, node): nodes of one file that contain another, by their spans.

    An ancestor holds its node's start, so nodes meet only where the block of a start is one of the ancestor's blocks.
    """
    at = lambda x: F.floor(x / BLOCK).cast("long")
    a = nodes.filter(F.col("start") <= F.col("end")).select("file", F.col("node").alias("ancestor"), F.col("start").alias("a1"), F.col("end").alias("a2"), F.explode(F.sequence(at(F.col("start")), at(F.col("end")))).alias("_block"))
    n = nodes.withColumn("_block", at(F.col("start")))
    return a.join(n, ["file", "_block"]).filter((F.col("ancestor") != F.col("node")) & (F.col("a1") <= F.col("start")) & (F.col("a2") >= F.col("end"))).select("file", "ancestor", "node")


def membership(things: DataFrame, categories: DataFrame, links: DataFrame, thing: str, category: str) -> DataFrame:
    """(thing, category) of all links whose both ends are known; either side may be asked for the other's members.

    Grammars are small next to what is parsed by them; the links are the large side and meet each in turn.
    """
    return links.select(thing, category).join(things, thing).join(categories, category)
