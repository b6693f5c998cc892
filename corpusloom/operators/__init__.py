"""DataFrame operators over markup corpora: tokens, quotes, blocks, nodes, diffs, expansion."""
