"""What is declared before a file is read: contracts, evolution rules and predicates."""
