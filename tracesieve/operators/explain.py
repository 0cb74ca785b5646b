"""Templates and glossary attached to labelled messages."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: (category, why, how, suggestion)
EXPLANATIONS: tuple[tuple[str, str, str, str], ...] = (
    ("syntax_error",
     "C++ has strict syntax rules. A missing semicolon, bracket, or parenthesis causes the parser to lose track of where one statement ends and another begins.",
     "Check the line reported and the line just before it. Look for a missing ';', unmatched '(' or '{', or a stray character.",
     "Fix the syntax error near the reported location."),
    ("name_resolution",
     "In C++, every variable, function, or class must be declared before it is used. It may also be in a different scope or namespace.",
     "Declare the variable before using it, check your spelling, or add the missing #include or 'using namespace std;'.",
     "Declare the identifier before use or add the missing #include."),
    ("type_error",
     "C++ is strongly typed. Operations between incompatible types are not allowed without an explicit cast.",
     "Check the types of the values involved. Add an explicit cast, change the variable type, or use the correct operator.",
     "Ensure both operands are compatible types or add an explicit cast."),
    ("missing_include",
     "The function or class you are using is defined in a header file that has not been included in your source file.",
     "Add the appropriate #include at the top of your file. For standard library features use angle brackets e.g. #include <iostream>.",
     "Add the missing #include directive at the top of your file."),
    ("linker_error",
     "The compiler found a declaration but no matching definition was compiled into the project.",
     "Make sure the .cpp file containing the definition is being compiled. Check for typos in the function name or missing library flags.",
     "Ensure the function is defined and all source files are being compiled."),
    ("redefinition",
     "C++ does not allow two definitions of the same variable or function in the same scope.",
     "Remove the duplicate definition. If it is coming from a header file, add #pragma once or include guards.",
     "Remove the duplicate definition or add include guards to your header."),
    ("access_error",
     "C++ enforces access control. Private members can only be accessed from within the class itself.",
     "Use a public getter/setter method, declare the accessing code as a friend, or change the member's access level.",
     "Use a public method to access the member or change its access level."),
    ("return_type_error",
     "In C++, non-void functions must return a value that matches their declared return type. main() must always return int.",
     "Add a return statement with the correct type. For main(), use 'return 0;' at the end.",
     "Add a return statement matching the function's declared return type."),
    ("other",
     "This may be a warning treated as an error, a platform-specific issue, or an uncommon language rule violation.",
     "Read the full compiler message carefully and check the indicated line for the root cause.",
     "Read the compiler message carefully and correct the highlighted code."),
)

# fixed values: glossary templates in lookup order, with category
GLOSSARY: tuple[tuple[str, str], ...] = (
    ("expected ';' before 'int'", "syntax_error"),
    ("lvalue required as left operand of assignment", "syntax_error"),
    ("'x' was not declared in this scope", "name_resolution"),
    ("'cout' was not declared in this scope", "missing_include"),
    ("ISO C++ forbids declaration of 'main' with no type", "syntax_error"),
    ("variable 'i' used in loop condition is never modified", "other"),
    ("array subscript is above array bounds", "other"),
    ("conversion from 'double' to 'float' may lose precision", "type_error"),
    ("'x' is used uninitialized in this function", "other"),
    ("condition is always false", "other"),
    ("null pointer dereference", "other"),
    ("array subscript out of bounds", "other"),
    ("infinite recursion detected", "other"),
    ("division by zero", "other"),
    ("use after free of pointer", "other"),
    ("memory leak: allocated memory is never freed", "other"),
    ("double free or corruption of pointer", "other"),
    ("invalid conversion from 'int' to 'int*'", "type_error"),
    ("'vector' was not declared in this scope", "missing_header"),
    ("iterator invalidated by erase", "other"),
    ("calling top() on empty container", "other"),
    ("getline skips input after formatted extraction", "other"),
    ("'cout' is not a member of 'std'", "name_resolution"),
    ("parameter 'x' is passed by value; changes will not affect the caller", "other"),
    ("assignment of read-only variable 'x'", "type_error"),
)


def explanation_table(df: DataFrame) -> DataFrame:
    """The nine-row template dimension (fixed size, so a broadcast is safe)."""
    return df.sparkSession.createDataFrame(list(EXPLANATIONS), "category string, why string, how string, suggestion string")


def explain(df: DataFrame, category: str, what: Column) -> DataFrame:
    """Adds ``explanation`` and ``suggestion``; NULL for an unknown category."""
    dim = F.broadcast(explanation_table(df)).withColumnRenamed("category", category)
    text = F.concat(F.lit("What happened:\n "), what, F.lit("\n\nWhy it happened:\n "), F.col("why"),
                    F.lit("\n\nHow to fix it:\n "), F.col("how"))
    return df.join(dim, category, "left").withColumn("explanation", text).drop("why", "how")


def glossary_entry(message: Column, templates: tuple[tuple[str, str], ...] = GLOSSARY) -> Column:
    """struct(template, category) of the first template contained in the message, else NULL.

    The table is a fixed list, so the lookup is a CASE chain on the row: no join at all.
    """
    low = F.lower(message)
    out = None
    for text, cat in templates:
        cond = low.contains(text.lower().strip("'\""))
        val = F.struct(F.lit(text).alias("template"), F.lit(cat).alias("category"))
        out = F.when(cond, val) if out is None else out.when(cond, val)
    return out
