"""Explicit schemas: captured payloads and the normalized listing."""

CARD_MODEL = """
    url string, price string, displayPrice string, displaySearchPriceRange string, listingType string,
    address struct<displayAddress:string, street:string, suburb:string, state:string, postcode:string, lat:double, lng:double>,
    features struct<beds:double, baths:double, parking:double, cars:double, propertyTypeFormatted:string,
        propertyType:string, landSize:double, landUnit:string>,
    branding struct<agencyId:string, agents:array<struct<agentName:string, name:string, agentPhoto:string>>>,
    inspection struct<openTime:string, closeTime:string>,
    auction string, promoType string, tags struct<tagText:string, tagClassName:string>, images array<string>
"""
CARD = f"id string, listingType string, listingModel string, {CARD_MODEL.replace('listingType string,', '', 1)}"
MEDIA = "array<struct<url:string, type:string, mediaCategory:string>>"
DAY = "struct<isoDate:string>"
DETAIL = f"""
    listingId string, listingType string, status string, seoUrl string, headline string, description string,
    priceDetails struct<displayPrice:string, rawValues:struct<`from`:bigint, `to`:bigint, exactPriceV2:bigint>>,
    displayableAddress struct<displayAddress:string, unitNumber:string, streetNumber:string, street:string,
        suburbName:string, state:string, postcode:string, geolocation:struct<latitude:double, longitude:double>>,
    bedrooms double, bathrooms double, carspaces double, propertyTypes array<string>, landAreaSqm double,
    buildingArea string, energyEfficiencyRating string, features array<string>,
    structuredFeatures array<struct<category:string, name:string>>,
    agents array<struct<fullName:string, email:string, mobileNumber:string, landlineNumber:string, profileUrl:string,
        photo:struct<url:string>, agentId:string>>,
    agency struct<name:string, branding:struct<logo:struct<url:string>>>,
    inspectionDetails struct<inspections:array<struct<openingDateTime:{DAY}, closingDateTime:{DAY}>>>,
    auctionDetails string,
    soldDetails struct<soldPrice:struct<rawValues:struct<exactPrice:bigint>>, soldDate:{DAY}, saleMethod:string,
        priceSource:string, governmentRecordedSoldPrice:string>,
    dateListedV2 {DAY}, dateUpdated {DAY}, virtualTourUrl string,
    largeMedia {MEDIA}, mediumMedia {MEDIA}, smallMedia {MEDIA}, thumbnailMedia {MEDIA}
"""
DIGITAL = "page struct<pageInfo:struct<search:map<string,string>>>"
_DIGITAL = "struct<page:struct<pageInfo:struct<search:map<string,string>>>>"
COMPONENT = f"""struct<digitalData:{_DIGITAL}, listingSearchResultIds:array<string>, totalListings:bigint,
    listingsMap:map<string,string>, listingId:string, rootGraphQuery:struct<listingByIdV2:string>>"""
NEXT = f"props struct<pageProps:struct<componentProps:{COMPONENT}, layoutProps:struct<digitalData:{_DIGITAL}>>>"
LD_ITEM = """array<struct<`@type`:string, name:string, description:string, url:string, startDate:string,
    location:struct<address:string, geo:string>, image:string>>"""
HUNTS = """hunts array<struct<name:string, enabled:boolean, max_items:int, enrich:boolean,
    filters:struct<mode:string, suburbs:array<string>, region:string, price_min:bigint, price_max:bigint, beds_min:int,
        beds_max:int, baths_min:int, cars_min:int, ptypes:array<string>, features:array<string>, keywords:string,
        exclude_under_offer:boolean, sort:string, page:int>>>"""
AGENT = "struct<name:string,email:string,mobile:string,landline:string,profile_url:string,photo:string,agent_id:string>"
IMAGE = "struct<url:string,type:string,category:string,position:int>"
INTERVAL = "struct<start:string,end:string>"
