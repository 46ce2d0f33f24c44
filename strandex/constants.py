"""Fixed values of the data model."""

#: Window, l-mer and spaced seed of a minimizer.
K, L = 35, 31
SEED_PATTERN = "1111111111111111101010101010101"
TOGGLE = 0xE37E28C4271B5A2D

#: Taxa that every index knows.
ROOT, CELLULAR, BACTERIA, ARCHAEA, FUNGI, VIRUSES = 1, 131567, 2, 2157, 4751, 10239
CORE_DOMAINS = (ROOT, CELLULAR, BACTERIA, ARCHAEA, FUNGI, VIRUSES)
CORE_NAMES = {ROOT: "root", CELLULAR: "cellular organisms", BACTERIA: "Bacteria", ARCHAEA: "Archaea", FUNGI: "Fungi", VIRUSES: "Viruses"}
DOMAIN_GROUPS = {"bacteria": BACTERIA, "archaea": ARCHAEA, "viral": VIRUSES, "fungi": FUNGI}
HUMAN, UNIVEC = 9606, 28384

#: Taxid that stands for an ambiguous read in a report, and its name there.
AMBIGUOUS, AMBIGUOUS_NAME = 4294967295, "\t"

MIN_HIT_GROUPS, DOMAIN_PENALTY, DOMAIN_FPR = 2, 1, 0.0001
SEGMENT = 4 << 20


def seed_mask(pattern: str = SEED_PATTERN) -> int:
    """Two bits for each base that the pattern keeps, the last base lowest."""
    return sum(3 << 2 * i for i, c in enumerate(reversed(pattern)) if c == "1")


def toggle_of(l: int = L) -> int:
    """The toggle cut to the bits of an l-mer."""
    return TOGGLE & ((1 << 2 * l) - 1)
