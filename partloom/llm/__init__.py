"""Operations of a training-data pipeline: one module for each operator, used by no other subpackage."""
