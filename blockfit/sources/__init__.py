from blockfit.sources.readers import (
    from_table,
    load_train_test,
    read_labeled_csv,
    read_labeled_text,
)
from blockfit.sources.sinks import load_model, save_model, write_residuals
