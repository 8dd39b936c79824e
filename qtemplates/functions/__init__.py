from qtemplates.functions.text import (  # noqa: F401
    PANDAS_NA_VALUES,
    blank_to_null,
    clean_line,
    first_n_words,
    last_n_words,
    normalize_template,
    null_if_na,
    py_split,
    py_strip,
    py_strip_chars,
    question_pattern,
    text_lines,
)
