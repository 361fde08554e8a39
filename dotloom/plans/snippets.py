"""Sample lines that the derived views add to the given prose.

The given documents are plain prose; these lines carry the shapes the text
rules react to, so that every rule fires at every scale.
"""

SNIPPETS = [
    "ƒ(x) = x + 1 and (-q, q) “quoted” 2×3÷4 – done",
    "g˘ ˘G ü s¸ ¸C ç Ö é ˘ g ¸ s ¨u q",
    "y = x−2",
    "∫_0^1 x^2 dx",
    "∫_{0}^{pi} sin(x) dx",
    "∫ x^2 dx",
    "d/dx (sin(x))",
    "d^2/dx^2 (x^3)",
    "∂ f / ∂x",
    "lim xSc f(x) = L , x -> 3 and a ≤b≥ c≠d / e",
    "5. Quotient Rule: lim x→c f(x)/g(x) = L/M, M ≠ 0",
    "lim x->c (f(x) + g(x)) = L + M",
    ":nt(exp(-x^2), x, -:nf, :nf) = sqrt(p:) l:m(x) s:nh(p:)",
    'K"okler ve "Usler, b"oyle hi¸c do˘gal OZELLIKLERI',
    "Bel:rl: Tr:gonometr:: L:m:t l:m:t: H:perbol:k a:b x:yzw",
    'o¨g˘retmen Tu¨rkc¸e x"yz IŞLEM İşlem kÖk',
    "\tTabs  and   spaces •item ●  more ▪x ◦y",
    "n/a",
    "  Unknown  ",
    "1. Kökler",
    "(2) second item",
    "a) lettered item",
    "- dashed item",
    "Continuity and Limits",
    "CHAPTER TWO",
    "2.3 The Limit Laws",
    "Figure 2.4 The graph of a function",
    "Table 3 Values of f",
    "EXAMPLE 5 Find the limits (a) lim x→2 x^2 (b) lim x→0 sin(x)",
    "Worked Example 7.1: Use the rules",
    "(a) first part (b) second part (C) third part",
    "THEOREM 1 Limit Laws If L, M and c are real numbers then",
    "Theorem 4 - Suppose f is continuous at c",
    "1. Sum Rule: lim x→c (f(x) + g(x)) = L + M",
    "2. Power Rule: [f(x)]^n (If n is a positive integer)",
    "(If the limit exists) we may write it",
    "Definition. A function is continuous",
    "Solution: by factoring",
    "Proof By the rules above",
    "Remark this is a note",
    "Exercises 2.1",
    "In words, the limit of a sum is the sum of the limits.",
    "so the limit exists",
    "Therefore f is bounded on the whole interval.",
    "= 3x^2 + 2",
    "+ 4 = 7",
    "f(x)g",
    "x→c",
    "sqrt(x) + 1/2 = 5",
    "2 + 3 * 4",
    "(2 + 3) * 4",
    "sin(x)^2 + cos(y+1)",
    "1/2",
    "Total 12345 and 678901 of 20242025",
    "ALL CAPS ΣΑ AND αβγ ΔELTA É",
    "x^2 y_1 z^Ab ^AB 5²½",
    "this sentence is continued on the next line and goes on with enough words to be prose",
    "and ends here with a full stop.",
    "gidebilece",
    "gız yolda inter-",
    "national words",
    "f = √ x + 1 and √ n f(x) and √nA",
    "lim (x^2 - 4) x→2",
]
