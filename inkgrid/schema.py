"""Tables of the data model, as DDL.

pixels: a row for each pixel; rows with a = 0 may be missing and count as transparent. tiles: a row for each block of an image,
row-major bytes with `components` bytes a pixel; the form for production.
"""

ARTWORKS = "image_id long, name string, width int, height int, dpi double, size_bytes long, modified timestamp, error string"
PIXELS = "image_id long, x int, y int, r int, g int, b int, a int"
TILES = "image_id long, tile_x int, tile_y int, left int, top int, width int, height int, components int, data binary"
PROFILE = "struct<brand:string,model:string,rip:string,machine:string,material:string,calibrated:boolean>"
OPTIONS = (
    "struct<lpi:double,angle:double,tolerance:double,softness:double,inputBlack:double,inputMidtone:double,inputWhite:double,outputBlack:double,outputWhite:double,"
    "minDiameterMM:double,alphaThreshold:double,shadowBoost:double,colorBoost:double,defringeRadius:double,defringeStrength:double,edgeContrast:double,edgeRadius:double,"
    "widthCM:double,heightCM:double,focusX:double,focusY:double,comparePosition:double,mockupChestCM:double,mockupHeightCM:double,mockupX:double,mockupY:double,diskBudgetGB:double,"
    "fillHolesMM:double,solidAbove:double,lineTrim:double,presmooth:double,inkColorMLm2:double,inkWhiteMLm2:double,inkColorPriceL:double,inkWhitePriceL:double,filmPriceM2:double,"
    "whiteChokeMM:double,knockout:boolean,recover:boolean,halftone:boolean,defringe:boolean,linkBackground:boolean,trimArt:boolean,convertCopy:boolean,batchWhite:boolean,key:string,"
    "shape:string,cleanup:string,cleanupMode:string,memoryMode:string,protection:string,viewMode:string,previewColor:string,sizeAxis:string,placement:string,shirtSize:string,"
    "garment:string,units:string,previewScope:string,gainPoints:string,whiteFormat:string>"
)
AREAS = "map<string,map<string,array<double>>>"
RECIPE = f"struct<id:string,name:string,options:{OPTIONS},areas:{AREAS},profile:{PROFILE}>"
PROGRESS = "seq long, id long, status string, output string, widthCM double, heightCM double, widthPX int, heightPX int, whiteOutput string, error string"
