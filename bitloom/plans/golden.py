"""Results that trees must give on generated fingerprints: fixed values."""

SEED = 12620509540149709235
#: Labels of 100 fingerprints of 2048 bits from that seed: threshold 0.3, branching 50, diameter.
LABELS = (
    1, 5, 6, 1, 1, 7, 8, 9, 1, 10, 1, 2, 11, 52, 12, 13, 14, 15, 16, 17, 18, 1, 19, 20, 21,
    1, 2, 22, 2, 23, 1, 24, 1, 1, 1, 25, 1, 1, 1, 1, 26, 1, 27, 28, 29, 1, 2, 30, 31, 2,
    32, 33, 34, 2, 2, 35, 36, 37, 38, 2, 2, 39, 1, 1, 40, 1, 1, 1, 1, 41, 42, 2, 2, 43, 44,
    2, 2, 45, 2, 2, 2, 46, 2, 47, 48, 2, 2, 1, 49, 2, 2, 1, 50, 2, 2, 3, 3, 51, 4, 4,
)
#: ... after the largest cluster was taken apart and all was inserted anew.
REFINED = (
    2, 1, 1, 3, 3, 1, 4, 1, 3, 5, 3, 1, 6, 46, 7, 8, 9, 10, 11, 12, 13, 2, 14, 15, 16,
    47, 1, 17, 1, 18, 2, 19, 2, 2, 2, 20, 2, 2, 2, 2, 21, 2, 22, 23, 24, 2, 1, 25, 3, 1,
    26, 27, 28, 1, 1, 29, 30, 31, 32, 1, 1, 33, 2, 48, 34, 49, 2, 2, 2, 35, 36, 1, 1, 37, 38,
    1, 1, 39, 1, 1, 1, 40, 1, 41, 42, 1, 1, 2, 43, 1, 1, 2, 44, 1, 1, 1, 1, 45, 1, 1,
)
#: Set bits of the first ten fingerprints of 2048 bits from another seed.
COUNTS_SEED = 17408390758220920002
COUNTS = (1137, 124, 558, 1159, 281, 323, 1264, 1252, 879, 631)
#: First members of the leading clusters of 3000 fingerprints from SEED: threshold 0.65, branching 50, diameter.
LEADING = (
    (2195, 2196, 2378, 2440, 2443, 2454, 2463, 2464, 2465, 2467, 2527, 2544),
    (1933, 1949), (2233, 2294), (1551, 1552), (1219, 1226), (614, 637),
)
#: Labels in turn of those clusters.
LEADING_LABELS = (1, 9, 10, 11, 12, 13)
