"""DataFrame -> DataFrame operators.

grading    response/question pairing, answer extraction, accuracy, run report
sampling   exact seeded fraction samples, four-way cuts, stratified splits
ordinal    positions and running sums inside (possibly hot) groups
stats      per-arm Gram matrices and reward sums, discounted statistics
routing    ridge solve, upper-confidence scoring, arm choice
policy     outcomes and metrics of a routing policy
online     per-key and micro-batch closed-loop learners
inference  batch scorer / embedder slots, hashed embeddings, last-token pooling
"""
