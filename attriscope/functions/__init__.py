from attriscope.functions.bands import BANDS, Band, band_dim, band_index, band_label, complete_bands
from attriscope.functions.finance import expected_loss, roi
from attriscope.functions.scorer import formula_margin, formula_risk

__all__ = [
    "BANDS", "Band", "band_dim", "band_index", "band_label", "complete_bands",
    "expected_loss", "roi", "formula_margin", "formula_risk",
]
