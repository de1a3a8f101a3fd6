"""Word lists of the program language."""

# The phrases by which steps are recognised. Order counts where the first that fits is taken.
AGGREGATE_WORDS = {
    "max": ("max", "highest", "largest", "most", "longest", "biggest", "more", "last", "longer", "higher", "larger"),
    "min": ("min", "lowest", "smallest", "least", "shortest", "less", "first", "shorter", "lower", "fewer", "smaller"),
    "count": ("number of",),
    "sum": ("sum", "total"),
    "avg": ("avg", "average", "mean "),
}
AGGREGATE_STARTS = (
    "number of", "highest", "largest", "lowest", "smallest", "maximum", "minimum", "max", "min",
    "sum", "total", "average", "avg", "mean of", "first", "last", "longest", "shortest",
)
AGGREGATE_PHRASE = {"min": "lowest", "max": "highest", "count": "number", "sum": "sum", "avg": "average"}
SUPERLATIVE_WORDS = (
    "highest", "largest", "most", "smallest", "lowest", "least", "longest", "shortest", "biggest",
    "maximum", "minimum", "top", "in top",
)
COMPARATIVE_WORDS = (
    "same as", "higher than", "larger than", "smaller than", "lower than", "more", "less", "at least", "at most",
    "equal", "is ", "are", "was", "contain", "include", "has", "have", "end with", "start with", "ends with",
    "starts with", "begin",
)
ARITHMETIC_WORDS = ("sum", "difference", "multiplication", "division")
BOOLEAN_STARTS = ("if ", "is ", "are ", "did ")
SORT_WORDS = (" sorted by", " order by", " ordered by")
DISCARD_WORDS = ("besides", "not in")
BOTH_WORDS = ("of both", "in both", "by both", "between both", "for both", "are both", "both of")
NUMBER_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
